"""Scores, grades, votes and rankings of sources, selectors, fields and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import urls
from sluice.functions.predicates import select_first
from sluice.functions.text import challenge_in_html, clean_text

# What names, selectors and values say about requests and fields.
DATA_WORDS = r"(?i)(api|graphql|ajax|search|complete|product|products|catalog|category|categories|browse|page=|offset=|limit=|cursor=|sort=|filter=|qid=|node=)"
FIELD_FAMILIES = {
    "title": ("title", "name"),
    "price": ("price", "price_high", "original_price", "salary", "salary_or_benefits"),
    "image": ("image", "image_src", "img", "photo"),
    "body": ("body", "description", "job_description", "requirements"),
    "location": ("location", "job_location"),
}
MONEY = r"(?i)[$€£¥]|\bUSD\b|\bEUR\b|\bGBP\b|\bRMB\b|\d"
PRICE_NOISE = r"(?i)(subtotal|installment|payment|klarna|afterpay|coupon|shipping|delivery|savings)"
IMAGE_URL = r"(?i)https?://|/[^ ]+\.(?:jpg|jpeg|png|webp|gif)"
BODY_NOISE = r"(?i)(recommend|related|review|customer|also bought|similar|variant|swatch)"
PLACE = r"(?i)\b(remote|hybrid|onsite|市|省|州|区|县|city|state)\b"
SELECTOR_RISK = {
    "title": (r"(?i)(breadcrumb|nav|menu|recommend|related|similar)", 0.25, "title_selector_may_target_navigation_or_recommendations"),
    "price": (r"(?i)(buybox|payment|subtotal|coupon|saving|installment)", 0.22, "price_selector_may_include_buybox_or_promo_text"),
    "image": (r"(?i)(recommend|related|sponsored|ad|banner|logo|avatar|sprite|icon)", 0.3, "image_selector_may_include_non_primary_images"),
    "location": (r"(?i)(footer|header|company|office)", 0.18, "location_selector_may_target_company_or_layout_text"),
}


def grade(score: Column) -> Column:
    return F.when(score >= 0.82, F.lit("A")).when(score >= 0.65, F.lit("B")).when(score >= 0.45, F.lit("C")).otherwise(F.lit("D"))


def network_score(url: Column, resource_type: Column, content_type: Column, status: Column, json_like: Column) -> Column:
    """How likely a request carries the page's data."""
    n = lambda c, points: F.when(F.coalesce(c, F.lit(False)), F.lit(points)).otherwise(F.lit(0))
    return (
        n(F.lower(resource_type).isin("xhr", "fetch"), 35)
        + n(F.lower(content_type).contains("json") | json_like, 25)
        + n(url.rlike(DATA_WORDS), 20)
        + n(urls.has_strong_pagination(urls.pagination_params(url)), 20)
        + n(status.between(200, 299), 10)
        - n(urls.is_static_asset(url) & ~json_like, 50)
    )


def network_entries(entries: DataFrame, order: str) -> DataFrame:
    """Entries (url, resource_type, content_type, status), the first of each URL, with json_like, static_asset and score."""
    first = select_first(entries.filter(F.coalesce("url", F.lit("")) != ""), ["url"], [order])
    like = urls.is_json_like(F.col("url")) | F.lower(F.coalesce("content_type", F.lit(""))).contains("json")
    out = first.withColumn("json_like", like)
    out = out.withColumn("static_asset", urls.is_static_asset(F.col("url")) & ~F.col("json_like"))
    return out.withColumn("score", network_score(F.col("url"), F.col("resource_type"), F.col("content_type"), F.col("status"), F.col("json_like")))


def network_candidates(entries: DataFrame, order: str, most: int = 30) -> DataFrame:
    return network_entries(entries, order).orderBy(F.desc("score"), F.asc(order)).limit(max(1, min(most, 100)))


def network_totals(entries: DataFrame, order: str) -> DataFrame:
    """(kind, value, n): entries by status and by resource type, and how many are candidates."""
    e = network_entries(entries, order)
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("status", F.coalesce(F.col("status").cast("string"), F.lit("unknown"))), ("type", F.coalesce("resource_type", F.lit("unknown"))), ("candidate", (F.col("score") > 0).cast("string")))])
    return e.select(F.explode(pairs).alias("x")).groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


def field_quality(samples: DataFrame, spec: dict[str, str], key: str = "key", order: str = "pos", site_type: str = "", most: int | None = None) -> DataFrame:
    """(key, field, score, grade, non_empty_ratio, risks, checks) from the first five samples of each key. most: characters of a value.

    samples: rows (key, order, values as map of field to text). spec: field to selector.
    """
    head = samples.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_k <= 5")
    sizes = head.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(s or "").alias("selector")) for f, s in spec.items()])
    value = clean_text(F.element_at("values", F.col("f.field")))
    value = value if most is None else F.substring(value, 1, most)
    each = head.select(key, "_k", F.explode(fields).alias("f"), "values").select(key, "_k", "f.field", "f.selector", value.alias("v"))
    by = each.groupBy(key, "field", "selector").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("v") != "", F.struct("_k", "v")))), lambda x: x["v"]).alias("vs")).join(sizes, key)
    vs, total, sel = F.col("vs"), F.greatest(F.col("_n"), F.lit(1)), F.col("selector")
    every = lambda p: F.size(vs).cast("int").__gt__(0) & F.forall(vs, p)
    share = lambda pattern: F.size(F.filter(vs, lambda v: v.rlike(pattern))) / total
    said = F.array_join(vs, " ")
    family = lambda k: F.col("field").isin(*FIELD_FAMILIES[k])
    ratio = F.least(F.lit(1.0), F.size(vs) / total)
    # (condition, points, risk or check): points are added, risks named if they take points away.
    rules: list[tuple[Column, Column, str]] = [
        (sel == "", F.lit(-0.35), "missing_selector"),
        (F.size(vs) == 0, F.lit(-0.3), "empty_values"),
        (family("title") & every(lambda v: F.length(v).between(5, 180)), F.lit(0.12), "title_length_plausible"),
        (family("price") & (share(MONEY) > 0), F.least(F.lit(0.18), share(MONEY) * 0.18), "numeric_or_currency_signal"),
        (family("price") & said.rlike(PRICE_NOISE), F.lit(-0.22), "price_value_may_include_payment_shipping_or_promo_noise"),
        (family("image") & (share(IMAGE_URL) > 0), F.least(F.lit(0.18), share(IMAGE_URL) * 0.18), "image_url_signal"),
        (family("body") & (F.size(vs) > 0) & (F.aggregate(vs, F.lit(0), lambda a, v: a + F.length(v)) >= 80 * F.size(vs)), F.lit(0.12), "description_length_plausible"),
        (family("body") & F.concat(sel, F.lit(" "), said).rlike(BODY_NOISE), F.lit(-0.22), "description_may_include_related_variant_or_review_noise"),
        (family("location") & F.exists(vs, lambda v: v.rlike(PLACE)), F.lit(0.1), "location_signal"),
    ]
    rules += [(family(k) & sel.rlike(p), F.lit(-minus), name) for k, (p, minus, name) in SELECTOR_RISK.items()]
    score = 0.3 + ratio * 0.45
    for when, points, _ in rules:
        score = score + F.when(when, points).otherwise(F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    risk = ("may", "missing", "empty")
    named = lambda bad: F.array_compact(F.array(*[F.when(w, F.lit(n)) for w, _, n in rules if any(r in n for r in risk) == bad]))
    review = {"ecommerce": ("price", "image_src", "body"), "jobs": ("salary", "salary_or_benefits", "location")}.get(site_type, ())
    extra = F.when(F.col("field").isin(*review), F.array(F.lit("ecommerce_field_review" if site_type == "ecommerce" else "job_field_review"))).otherwise(F.array().cast("array<string>")) if review else F.array().cast("array<string>")
    return by.select(key, "field", "selector", F.round(score, 3).alias("score"), grade(score).alias("grade"), F.round(ratio, 3).alias("non_empty_ratio"), F.slice(vs, 1, 3).alias("sample_values"), named(True).alias("risks"), F.concat(named(False), extra).alias("checks"))


def quality_report(fields: DataFrame, key: str = "key") -> DataFrame:
    """(key, overall_score, overall_grade, risk_flags) of field_quality's rows."""
    mean = F.avg("score")
    return fields.groupBy(key).agg(F.round(mean, 3).alias("overall_score"), grade(mean).alias("overall_grade"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("risks")))).alias("risk_flags"))


def response_score(html: Column, hits: Column | None = None, js_shell: Column | None = None) -> Column:
    """How useful a response is: length, embedded data, selector hits, less for challenges, shells, errors, short bodies."""
    t = F.coalesce(html, F.lit(""))
    low = F.lower(t)
    n = lambda c, points: F.when(c, F.lit(float(points))).otherwise(F.lit(0.0))
    score = F.least(F.length(t), F.lit(500_000)) / 1000 + n(low.contains("application/ld+json"), 80) + n(low.contains("jobposting"), 120)
    score = score + n(low.contains("__next_data__") | low.contains("window.__appdata") | low.contains("window.__initial_state"), 50)
    if hits is not None:
        score = score + hits * 25
    if js_shell is not None:
        score = score - n(js_shell, 80)
    broken = F.ltrim(t).startswith("{") & (low.contains("fetch_failed") | low.contains('"error"'))
    return F.round(score - n(challenge_in_html(t) != "", 250) - n(broken, 300) - n(F.length(t) < 500, 50), 2)


def js_shell(text_chars: Column, scripts: Column, app_roots: Column, challenge: Column) -> Column:
    return (challenge == "") & (((text_chars < 500) & (scripts >= 8)) | ((app_roots > 0) & (text_chars < 1200)))


def vote(rows: DataFrame, field: str, value: str, order: str) -> DataFrame:
    """Per field the value that most rows name, of equal ones the first named: (field, value, votes, rows, confidence)."""
    votes = rows.groupBy(field, value).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("_first"))
    best = votes.groupBy(field).agg(F.max_by(F.struct(value, "votes"), F.struct("votes", -F.col("_first"))).alias("b"), F.sum("votes").alias("rows"))
    return best.select(field, f"b.{value}", "b.votes", "rows", F.round(F.col("b.votes") / F.col("rows"), 3).alias("confidence"))


def rank_sources(groups: list[DataFrame], key: list[str], order: list[Column], most: int) -> DataFrame:
    """The union of candidate groups, the best of each key, ranked, the first `most`."""
    union = groups[0]
    for g in groups[1:]:
        union = union.unionByName(g, allowMissingColumns=True)
    return select_first(union, key, order).orderBy(*order).limit(most)


def merge_first(groups: list[DataFrame], key: list[str], most: int = 20) -> DataFrame:
    """Groups of recommendations, each in its order `pos`, one after the other; repeats once; the first `most`."""
    parts = [g.withColumn("_g", F.lit(i)) for i, g in enumerate(groups)]
    return rank_sources(parts, key, [F.asc("_g"), F.asc("pos")], most).drop("_g")


def recommend_schema(plan: DataFrame, quality: DataFrame) -> DataFrame:
    """(field, type, score, grade): the plan's fields with the quality that was measured, if it was."""
    kind = F.when(F.col("field").rlike("(?i)(price|amount|salary|score|rating)"), F.lit("REAL")).when(F.col("field").rlike("(?i)(count|rank|index)$"), F.lit("INTEGER")).otherwise(F.lit("TEXT"))
    joined = plan.join(quality, "field", "left")
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    return joined.select("field", kind.alias("type"), score.alias("score"), grade(score).alias("grade"))


def first_rule(rows: DataFrame, url: str, rules: list[tuple[str, str]]) -> DataFrame:
    """rows with `target` of the first rule whose pattern matches; rows that none matches go. No rules keep all."""
    if not rules:
        return rows.withColumn("target", F.lit(None).cast("string"))
    out = F.when(F.lit(False), F.lit(""))
    for pattern, target in rules:
        out = out.when(F.col(url).rlike(pattern), F.lit(target))
    return rows.withColumn("target", out).filter(F.col("target").isNotNull())


def menu_source_score(path: Column, is_list: Column, size: Column) -> Column:
    low = F.lower(path)
    n = lambda word, points: F.when(low.contains(word), F.lit(points)).otherwise(F.lit(0))
    return 20 + n("multibrandmenu", 30) + n("mainmenu", 25) + n("navigation", 15) + F.when(is_list, F.least(size, F.lit(20))).otherwise(F.least(size, F.lit(10)))


def selector_stability(selector: Column) -> Column:
    n = lambda c, points: F.when(c, F.lit(points)).otherwise(F.lit(0))
    return n(selector.contains("#"), 7) + n(selector.contains("."), 5) + n(selector.contains("itemprop") | selector.contains("data-test"), 6) - n(selector.rlike("(?i)(css-[a-z0-9]{4,}|[a-f0-9]{8,})"), 6)


def probe_summary(probes: DataFrame, key: str = "url") -> DataFrame:
    """(url, categories, first_ok): of probes (url, mode, ord, ok, categories) all categories and the first mode that worked."""
    return probes.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("categories")))).alias("categories"), F.min_by("mode", F.when(F.col("ok"), F.col("ord"))).alias("first_ok"))


def overall_confidence(list_hits: Column, samples: Column, field_scores: Column) -> Column:
    """Mean of how many of the samples a list selector covers (at most all) and of the fields' scores (an array); the first alone without fields."""
    lists = F.least(F.lit(1.0), F.coalesce(list_hits, F.lit(0)) / F.greatest(F.lit(1), samples))
    fields = F.aggregate(field_scores, F.lit(0.0), lambda a, x: a + x) / F.size(field_scores)
    return F.round(F.when(F.size(field_scores) > 0, (lists + fields) / 2).otherwise(lists), 3)
