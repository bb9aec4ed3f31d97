"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern; each pattern offers
its words once for each repetition, at a cost that rises with every repetition; each source asks for its
target. The cheapest flow from patterns to sources says how many words of each pattern every source
takes; then whole documents are selected for it in seeded order. The driver holds one number for each
membership pattern and solves the flow, however many there are; documents and sums stay in tables.

Edge cases: a null text has size 0 and is taken 0 times; a null source is a source of its own and comes
last; repeated rows count each; ties in the seeded order fall to documents of the same id, ordered by
size; rows without an id are ordered by their texts; an empty table gives an empty table; extra columns
stay, whatever their names, but for those that have the names of the results, which take their place.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.session import fresh, write_out

#: Each document is taken at most so many times.
REPEATS = 3
#: Parts into which the seeded order of a pattern is cut; the running sum inside one is a single task's work.
PARTS = 4096
#: Quotas and cuts of patterns that take up to so many bytes are broadcast; more of them are joined by pattern.
BROADCAST_BYTES = 8 << 20

GAP_CHARS = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP_CHARS), "")).cast("long")


def targets(sizes: list[tuple[str | None, int]], repeats: int = REPEATS) -> dict[str | None, float]:
    """Each source's share of all words by weights 1, 2, 3, 1, ..., none above repeats times its own words.

    Sources are in order of code points, null last. What a source can't take is shared by weight among the
    others: sources are capped in order of size to weight until the common level fits under the next cap.
    """
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weighted = [(name, size, 1 + i % 3) for i, (name, size) in enumerate(ordered)]
    left, weight = sum(size for _, size, _ in weighted), sum(w for *_, w in weighted)
    out: dict[str | None, float] = {}
    for name, size, w in sorted(weighted, key=lambda x: x[1] / x[2]):
        if len(out) < len(weighted) and left * w > repeats * size * weight:
            out[name] = float(repeats * size)
            left, weight = left - repeats * size, weight - w
        else:
            break
    level = left / weight if weight else 0.0
    return {name: out.get(name, level * w) for name, _, w in weighted}


def min_cost_flow(patterns: dict[tuple, int], quotas: dict, repeats: int = REPEATS) -> dict[tuple, float]:
    """Words that each pattern gives, by the cheapest flow that meets the quotas as far as possible.

    The n-th copy of a pattern's words costs n. With costs that only depend on the level of repetition,
    the cheapest flow opens the levels one by one: at each level, quotas that are left are met by as much
    flow as the level allows, which successive augmenting paths over pattern-source edges find.
    """
    flow: dict[tuple, dict] = {p: {} for p in patterns}
    need = {s: float(q) for s, q in quotas.items()}
    given = dict.fromkeys(patterns, 0.0)
    order = sorted(patterns, key=lambda p: (len(p), [(x is None, x or "") for x in p]))
    offers: dict = {}
    for p in order:
        for s in p:
            offers.setdefault(s, []).append(p)
    for level in range(1, repeats + 1):
        for p in order:  # greedy start: patterns of few sources first
            for s in p:
                take = min(patterns[p] * level - given[p], need.get(s, 0.0))
                if take > 0:
                    flow[p][s] = flow[p].get(s, 0.0) + take
                    given[p] += take
                    need[s] -= take
        if all(len(p) == 1 for p in order):
            continue
        for source in sorted((s for s in need if need[s] > 1e-6), key=lambda s: (s is None, s or "")):
            while need[source] > 1e-6 and (path := _augment(source, offers, patterns, level, flow, given)):
                pushed = min([need[source], patterns[path[-1][0]] * level - given[path[-1][0]], *(flow[p][t] for p, t in path[:-1] if t is not None)])
                at = source
                for p, t in path:  # at takes from p; the source t that p served so far goes on along the path
                    flow[p][at] = flow[p].get(at, 0.0) + pushed
                    if t is not None:
                        flow[p][t] -= pushed
                        at = t
                given[path[-1][0]] += pushed
                need[source] -= pushed
    return given


def _augment(source, offers, patterns, level, flow, given):
    """A shortest path of (pattern, source whose words it frees) that ends in a pattern with words left."""
    heap, before, n = [(0, 0, source)], {source: None}, 0
    used: set = set()
    while heap:
        steps, _, s = heapq.heappop(heap)
        for p in offers.get(s, ()):
            if p in used:
                continue
            used.add(p)
            if patterns[p] * level - given[p] > 1e-6:
                path, at = [(p, None)], s
                while before[at] is not None:
                    at_p, prev = before[at]
                    path.append((at_p, at))
                    at = prev
                return path[::-1]
            for t, v in flow[p].items():
                if v > 1e-6 and t not in before:
                    before[t] = (p, s)
                    n += 1
                    heapq.heappush(heap, (steps + 1, n, t))
    return None


def mix(docs: DataFrame, text: str = "text", sources: str = "source", doc_id: str = "doc_id", seed: str = "mix", repeats: int = REPEATS, prefix: str = "mix_") -> DataFrame:
    """docs with size, source_size, target and taken, each name behind prefix.

    `sources` is a string column or an array of strings (a document of several sources). source_size and
    target are those of the document's pattern: its one source's, or the sums over its sources.
    """
    several = dict(docs.dtypes)[sources].startswith("array")
    size, pat, part, key, chosen = (fresh(x, docs) for x in ("q_size", "q_pattern", "q_part", "q_key", "q_chosen"))
    source_size, target, times, rest, cut, before, of = (fresh(x, docs) for x in ("q_source_size", "q_target", "q_times", "q_rest", "q_cut", "q_before", "q_of"))
    pattern = F.array_sort(F.array_distinct(F.col(sources))) if several else F.array(F.col(sources).cast("string"))
    sized = docs.withColumns({size: n_words(F.col(text).cast("string")), pat: F.coalesce(pattern, F.array(F.lit(None).cast("string")))})
    named_by = F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))
    sized = sized.withColumn(key, F.md5(F.concat(F.lit(f"{seed}:"), named_by)))
    sized = sized.withColumn(part, F.conv(F.substring(key, 1, 3), 16, 10).cast("int"))
    groups = write_out(sized.groupBy(F.col(pat).alias("pat"), F.col(part).alias("part")).agg(F.sum(size).alias("words")), "mix_parts")
    patterns = {tuple(r[0]): int(r[1]) for r in groups.groupBy("pat").agg(F.sum("words").alias("words")).toLocalIterator()}
    of_source: dict = {}
    for p, words in patterns.items():
        for s in p:
            of_source[s] = of_source.get(s, 0) + words
    goals = targets(list(of_source.items()), repeats)
    given = min_cost_flow(patterns, goals, repeats)

    rows = []
    for p, words in patterns.items():
        n = int(given[p] // words) if words else 0
        rows.append((list(p), sum(of_source[s] for s in p), float(sum(goals[s] for s in p)), n, float(given[p] - n * words)))
    quotas = docs.sparkSession.createDataFrame(rows, f"{of} array<string>, {source_size} long, {target} double, {times} int, {rest} double")
    order = Window.partitionBy("pat").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # At most PARTS rows a pattern: where each part of the seeded order starts.
    starts = groups.select("pat", "part", (F.sum("words").over(order) - F.col("words")).alias("start"), "words")
    plan = write_out(starts.join(quotas, F.col("pat") == F.col(of)), "mix_plan")
    last = plan.filter((F.col("start") <= F.col(rest)) & (F.col("start") + F.col("words") > F.col(rest)))
    cuts = last.groupBy("pat").agg(F.max("part").alias(cut), F.max_by("start", "part").alias(before))
    cuts = write_out(quotas.join(cuts, F.col("pat") == F.col(of), "left").drop("pat"), "mix_cuts")
    held = cuts.select(F.sum(64 + F.octet_length(F.concat_ws("", of)) + 16 * F.size(of))).first()[0] or 0
    joined = sized.join(F.broadcast(cuts) if held <= BROADCAST_BYTES else cuts, F.col(pat) == F.col(of), "left")
    inside = F.col(part) == F.col(cut)
    whole = joined.withColumn(chosen, F.when(F.col(cut).isNull(), F.col(rest) > 0).otherwise(F.col(part) < F.col(cut)))
    # The running sum of each document inside its part: tasks hold a part of a source, never a whole one.
    seq = Window.partitionBy(pat, part).orderBy(key, size).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = whole.filter(inside).withColumn(chosen, F.col(before) + F.sum(size).over(seq) - F.col(size) / 2 <= F.col(rest))
    both = whole.filter(F.coalesce(~inside, F.lit(True))).unionByName(near)
    taken = F.col(size) * (F.col(times) + F.col(chosen).cast("int"))
    named = {"size": F.col(size), "source_size": F.col(source_size), "target": F.col(target), "taken": taken.cast("long")}
    kept = [c for c in docs.columns if c.lower() not in {(prefix + k).lower() for k in named}]
    return both.select(*[F.col(c) for c in kept], *[c.alias(prefix + k) for k, c in named.items()])
