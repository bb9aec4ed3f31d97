"""Reports about sites: access, signals, scores, data sources and candidate selectors of many pages at once.

analyze() gives one row a page. Only the documents for people, of one site each, meet on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import text, urls
from sluice.operators import extract, fused, score
from sluice.operators.memory import target_key, upsert_latest
from sluice.session import write_out


def analyze(pages: DataFrame, goal: str = "", fields: list[str] = (), *, html: str = "html", url: str = "url", also: dict[str, fused.Extractor] | None = None) -> DataFrame:
    """pages' other columns with signals, challenge, js_shell, categories, response_score, site_type, findings and ok.

    also: further extractors, whose columns come from the same reading of the pages.
    """
    also = also or {}
    read = fused.read(pages, {"_text": fused.TEXT, "signals": fused.SIGNALS, **also}, html=html, url=url)
    kinds = text.site_type_scores(F.concat_ws(" ", F.lit(goal), F.col(url), F.col("_text")), list(fields))
    challenge = text.challenge_in_html(F.col(html))
    s = F.col("signals")
    shell = score.js_shell(s["text_chars"], s["scripts"], s["app_roots"], challenge)
    found = F.array_compact(
        F.array(
            F.when(challenge != "", F.concat(F.lit("challenge_detected:"), challenge)),
            F.when(shell, F.lit("js_rendering_likely_required")),
            F.when((s["jsonld"] > 0) | s["next_data"] | s["nuxt_data"], F.lit("embedded_structured_data_available")),
        )
    )
    return read.select(
        *[c for c in pages.columns if c != html],
        *also,
        "signals",
        challenge.alias("challenge"),
        shell.alias("js_shell"),
        text.access_categories(F.col("_text"), js_shell=shell).alias("categories"),
        score.response_score(F.col(html), js_shell=shell).alias("response_score"),
        text.best_site_type(kinds).alias("site_type"),
        found.alias("findings"),
        (challenge == "").alias("ok"),
    )


def site_summary(analyzed: DataFrame, url: str = "url") -> DataFrame:
    """(host, pages, ok, mean_score, site_type): one row a host; the type is the one most pages have. Scores are summed exactly."""
    by = analyzed.groupBy(urls.host(F.col(url)).alias("host"), "site_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("ok"), F.sum(F.col("response_score").cast("decimal(18,2)")).alias("score"))
    return by.groupBy("host").agg(F.sum("n").alias("pages"), F.sum("ok").alias("ok"), F.round(F.sum("score") / F.sum("n"), 2).cast("double").alias("mean_score"), F.max_by("site_type", F.struct("n", "site_type")).alias("site_type"))


def site_spec(pages: DataFrame, fields: list[str], *, html: str = "html", url: str = "url") -> DataFrame:
    """(field, selector, votes, rows, confidence): the selector that most pages put first for each field."""
    top = extract.selector_candidates(pages, fields, html=html, url=url, most=1)
    return score.vote(top.withColumn("_pos", F.pmod(F.xxhash64(url), F.lit(1 << 40))), "field", "selector", "_pos")


# Kinds of pages and sources of data with the confidence in each. Of page kinds the last that holds counts, with the
# highest confidence of all that hold; of sources the first.
PAGE_KINDS = [
    ("unknown", 0.3, lambda f: True),
    ("list", 0.78, lambda f: f["detail_links"] >= 2 or f["list_selector"]),
    ("detail_or_content", 0.55, lambda f: f["field_candidates"] and not f["detail_samples"]),
    ("paginated_list", 0.84, lambda f: f["pagination"]),
]
KIND_NAMES = {("jobs", "list"): "job_list", ("ecommerce", "list"): "product_list", ("ecommerce", "paginated_list"): "paginated_product_list"}
DATA_SOURCES = [
    ("public_api_or_initial_state", 0.78, lambda f: f["api_candidates"]),
    ("browser_dom", 0.74, lambda f: f["best_mode"] == "browser"),
    ("static_dom", 0.72, lambda f: f["list_selector"]),
    ("manual_review", 0.45, lambda f: True),
]


def page_type(detail_links: int, list_selector: str, pagination: str, site_type: str, field_candidates: bool = False, detail_samples: int = 0) -> tuple[str, float]:
    facts = {"detail_links": detail_links, "list_selector": list_selector, "pagination": pagination, "field_candidates": field_candidates, "detail_samples": detail_samples}
    held = [(kind, confidence) for kind, confidence, holds in PAGE_KINDS if holds(facts)]
    return KIND_NAMES.get((site_type, held[-1][0]), held[-1][0]), max(c for _, c in held)


def data_source(api_candidates: int, best_mode: str, list_selector: str) -> tuple[str, float]:
    facts = {"api_candidates": api_candidates, "best_mode": best_mode, "list_selector": list_selector}
    return next((source, confidence) for source, confidence, holds in DATA_SOURCES if holds(facts))


def site_facts(pages: DataFrame, goal: str = "", fields: list[str] = ("title",), *, html: str = "html", url: str = "url") -> DataFrame:
    """What one reading of the pages tells, without their texts, written: analyze()'s columns, candidates of each field, hints and next pages."""
    also = {"candidates": fused.candidates(["link", *fields], 1), "hint_list": fused.HINTS, "paging": fused.PAGINATION}
    # A Parquet file of many pages may be a few row groups, hence a few tasks: pages are dealt to all before they are parsed.
    dealt = pages.select(url, html).repartition(4 * pages.sparkSession.sparkContext.defaultParallelism)
    return write_out(analyze(dealt, goal, list(fields), html=html, url=url, also=also), "facts")


def _most(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n): the value that most rows of the keys have, of equally frequent ones the greatest."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max(F.struct("n", value)).alias("b")).select(*keys, f"b.{value}", "b.n")


def targets(facts: DataFrame, at: float, url: str = "url") -> DataFrame:
    """What site_facts tell about each host, as records for the memory of targets, by target_key.

    (target_key, host, target_type, pages, readable, preferred_mode, pagination_type, selectors, findings, updated_at): types and
    paging are those of most pages, selectors (field to selector) those that most pages put first.
    """
    f = facts.withColumn("host", urls.host(F.col(url)))
    total = f.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if("ok").alias("readable"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("findings")))).alias("findings"))
    kind = _most(f, ["host"], "site_type").select(F.col("host").alias("_k"), F.col("site_type").alias("target_type"))
    paging = _most(f.withColumn("kind", F.get("paging", F.lit(0))["kind"]), ["host"], "kind").select(F.col("host").alias("_p"), F.col("kind").alias("pagination_type"))
    votes = _most(f.select("host", F.explode("candidates").alias("c")).select("host", F.col("c.field").alias("field"), F.col("c.selector").alias("selector")), ["host", "field"], "selector")
    chosen = votes.groupBy(F.col("host").alias("_s")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "selector")))).alias("selectors"))
    out = total
    for side, key in ((kind, "_k"), (paging, "_p"), (chosen, "_s")):
        out = out.join(side, F.col("host").eqNullSafe(F.col(key)), "left").drop(key)
    mode = F.when(F.col("readable") > 0, F.lit("requests")).otherwise(F.lit("browser"))
    key = target_key(F.col("target_type"), F.col("host"), F.concat(F.lit("http://"), "host", F.lit("/")))
    return out.select(key.alias("target_key"), "host", "target_type", "pages", "readable", mode.alias("preferred_mode"), "pagination_type", "selectors", "findings", F.lit(at).alias("updated_at"))


def remember_targets(known: DataFrame | None, facts: DataFrame, at: float, url: str = "url") -> DataFrame:
    """The memory of targets with what an analysis has found; of a target the latest record stays."""
    new = targets(facts, at, url)
    return upsert_latest(new if known is None else known.unionByName(new), "target_key", "updated_at")


def interactions(facts: DataFrame, url: str = "url") -> DataFrame:
    """(host, action, strategy, confidence, samples): how each host's pages lead on: by paging and by requests that page.

    Of each action the strategy of most pages, and up to five URLs, the least.
    """
    f = facts.withColumn("host", urls.host(F.col(url)))
    first = f.select("host", F.get("paging", F.lit(0)).alias("p")).filter("p is not null").select("host", F.lit("paginate").alias("action"), F.col("p.kind").alias("strategy"), F.col("p.confidence").alias("confidence"), F.col("p.next").alias("sample"))
    paged = f.select("host", F.explode("hint_list").alias("h")).filter("h.paged").select("host", F.lit("network_pagination").alias("action"), F.when(F.col("h.json_like"), F.lit("json")).otherwise(F.lit("page")).alias("strategy"), F.lit(0.78).alias("confidence"), F.col("h.hint").alias("sample"))
    rows = write_out(first.unionByName(paged), "interactions")
    best = _most(rows, ["host", "action"], "strategy").withColumnsRenamed({"host": "_h", "action": "_a", "strategy": "_s"})
    # Samples are the least of each task first, so no host's list is longer than what is shown.
    ranked = rows.select("host", "action", "strategy", "confidence", "sample").distinct()
    least = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("host", "action", "strategy").orderBy("sample"))).filter("_n <= 5")
    by = least.groupBy("host", "action", "strategy").agg(F.max("confidence").alias("confidence"), F.sort_array(F.collect_list("sample")).alias("samples"))
    return by.join(best, F.col("host").eqNullSafe(F.col("_h")) & (F.col("action") == F.col("_a")) & (F.col("strategy") == F.col("_s")), "left_semi")


def site_model(pages: DataFrame, goal: str = "", fields: list[str] = ("title",), *, html: str = "html", url: str = "url") -> dict:
    """The document about one site: summary, sources, selectors, pagination and recommendations.

    Pages are read once, and what that gives, without their texts, is written; all parts are sums over it.
    """
    facts = site_facts(pages, goal, fields, html=html, url=url)
    hosts = site_summary(facts, url).orderBy(F.desc("pages"), "host").limit(20).collect()
    top = facts.select(url, F.explode("candidates").alias("c")).select(url, "c.*")
    spec = {r["field"]: r["selector"] for r in score.vote(top.withColumn("_pos", F.pmod(F.xxhash64(url), F.lit(1 << 40))), "field", "selector", "_pos").collect()}
    hints = facts.select(F.explode("hint_list").alias("h")).select("h.*").groupBy("hint").agg(F.count(F.lit(1)).alias("n"), F.bool_or("json_like").alias("json_like")).orderBy(F.desc("json_like"), F.desc("n"), "hint").limit(12).collect()
    paging = facts.select(F.get("paging", F.lit(0))["kind"].alias("kind")).filter("kind is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind").first()
    site = hosts[0]["site_type"] if hosts else "unknown"
    source, confidence = data_source(sum(h["json_like"] for h in hints), "", spec.get("link", ""))
    kind, sure = page_type(2 if spec.get("link") else 0, spec.get("link", ""), paging["kind"] if paging and paging["kind"] != "page_param_guess" else "", site)
    return {
        "goal": goal,
        "hosts": [h.asDict() for h in hosts],
        "site_type": site,
        "page_type": {"type": kind, "confidence": sure},
        "data_source": {"preferred": source, "confidence": confidence},
        "api_hints": [h.asDict() for h in hints],
        "selectors": spec,
        "pagination": paging["kind"] if paging else "",
    }


def markdown(model: dict) -> str:
    row = lambda *cells: "| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |"
    lines = [f"# {model['goal'] or 'Site report'}", "", row("Host", "Pages", "Readable", "Mean score", "Type"), row(*["---"] * 5)]
    lines += [row(h["host"], h["pages"], h["ok"], h["mean_score"], h["site_type"]) for h in model["hosts"]]
    lines += ["", f"Source: {model['data_source']['preferred']}. Pages: {model['page_type']['type']}. Paging: {model['pagination'] or 'none'}.", "", row("Field", "Selector"), row("---", "---")]
    return "\n".join([*lines, *[row(k, v) for k, v in model["selectors"].items()]]) + "\n"
