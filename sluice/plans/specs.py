"""Plans and site specifications: what is wrong with them, how they fare on landed pages, and their versions.

A plan says what to collect from one site, a specification adds selectors for lists and details. Both are plain
dictionaries. Checks on pages are DataFrame operators: a row for each page and rule.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import urls
from sluice.operators import dom, extract, fused, search
from sluice.plans.pipeline import PLAN_PARTS, from_plan
from sluice.session import write_out

# Names of faults, and of risks that a plan runs, in their order.
SPEC_RULES: list[tuple[str, Callable[[dict], bool]]] = [
    ("site is required", lambda s: bool(s.get("site"))),
    ("start_urls must be a non-empty list", lambda s: isinstance(s.get("start_urls"), list) and bool(s["start_urls"])),
    ("list.item_link is required", lambda s: isinstance(s.get("list"), dict) and bool(s["list"].get("item_link"))),
    ("detail must be a non-empty object", lambda s: isinstance(s.get("detail"), dict) and bool(s["detail"])),
]
#: What a plan that has these parts is read to mean.
ASSUMPTIONS = {
    "list_selector": "Each link that the list selector finds leads to a page of its own to be read.",
    "detail_urls": "The given detail URLs answer without a list page before them.",
    "category_urls": "One list selector serves all category pages.",
    "menu_source_path": "Categories are those of the menu at the given path.",
    "fields": "Fields are looked for on detail pages, never on lists.",
}
DEFAULT_FIELDS = ("title", "price", "image_src")
BODY_WORDS = ("body", "description", "详情", "描述")


def _part(plan: dict, name: str):
    return next((plan[n] for n in PLAN_PARTS[name] if plan.get(n)), None)


def requested_fields(goal: str = "", fields: str = "") -> list[str]:
    """The fields that are asked for, or those that the goal calls for."""
    asked = [f.strip() for f in fields.split(",") if f.strip()]
    return asked or [*DEFAULT_FIELDS, *(["body"] if any(w in goal.lower() for w in BODY_WORDS) else [])]


def is_url(text: str) -> bool:
    return text.startswith(("http://", "https://")) and len(text.split("/")) > 2 and bool(text.split("/")[2])


class Shape(NamedTuple):
    """What a part of a plan must be: url, urls or object; and what is said if it lacks, is something else or holds no URL."""

    parts: tuple[str, ...]
    kind: str = ""
    lacks: str = ""
    error: bool = False
    wrong: str = ""
    no_url: str = ""


# The codes.
PLAN_SHAPE = (
    Shape(("start",), "url", lacks="missing_start_url", error=True, no_url="invalid_start_url"),
    Shape(("lists",), "urls", wrong="category_urls_must_be_array", no_url="invalid_category_url"),
    Shape(("selector", "details"), lacks="no_list_selector_or_detail_urls"),
    Shape(("fields",), "object", lacks="no_fields", wrong="fields_must_be_object"),
)
_KINDS = {"urls": list, "object": dict}
RISK_CODES = {"single": "single_detail_fallback", "orphans": "category_urls_without_menu_source", "browser": "browser_rendering_required", "challenge": "challenge_detected", "truncated": "html_truncated_likely"}


def _fault(shape: Shape, value) -> str:
    """What is wrong with a part that is there."""
    if not isinstance(value, _KINDS.get(shape.kind, object)):
        return shape.wrong
    given = value if shape.kind == "urls" else [value] if shape.kind == "url" else []
    return next((f"{shape.no_url}:{u}" for u in given if not is_url(str(u))), "")


def plan_faults(plan: dict) -> dict:
    """(ok, errors, warnings) of a plan by its shape alone."""
    told: dict[bool, list[str]] = {True: [], False: []}
    for shape in PLAN_SHAPE:
        held = [v for v in (_part(plan, name) for name in shape.parts) if v]
        if not held and shape.lacks:
            told[shape.error].append(shape.lacks)
        told[True] += [f for v in held if (f := _fault(shape, v))]
    return {"ok": not told[True], "errors": told[True], "warnings": told[False]}


def plan_risks(plan: dict, challenge: bool = False, truncated: bool = False) -> list[str]:
    """Codes of what may go wrong, and the fields that have no selector."""
    reached = any(plan.get(k) for k in ("list_selector", "detail_urls", "urls"))
    runs = {"single": not reached, "orphans": plan.get("category_urls") and not plan.get("menu_source_path"), "browser": plan.get("mode") == "browser", "challenge": challenge, "truncated": truncated}
    open_fields = ",".join(f for f, selector in (plan.get("fields") or {}).items() if not selector)
    return [code for k, code in RISK_CODES.items() if runs[k]] + [f"missing_field_selectors:{open_fields}"] * bool(open_fields)


def with_metadata(plan: dict, version: str = "1", **signs: bool) -> dict:
    """The plan with its kind and version, what it takes for granted, and its risks."""
    told = [text for part, text in ASSUMPTIONS.items() if plan.get(part)]
    return {"version": version, "kind": "collection_plan"} | plan | {"assumptions": [*plan.get("assumptions", ()), *told], "risk_flags": plan_risks(plan, **signs)}


def validate_plan(plan: dict, pages: DataFrame | None = None) -> dict:
    """Faults and warnings of a plan, its pipeline, and what its list selector finds on the landed start page."""
    out = plan_faults(plan)
    if not out["ok"]:
        return out | {"pipeline": None}
    out["pipeline"] = from_plan(plan, validate_only=True)
    selector = _part(plan, "selector")
    if pages is not None and selector:
        start = pages.filter(urls.canonical_url(F.col("url")) == urls.canonical_url(F.lit(_part(plan, "start"))))
        links = write_out(extract.links(start, selector), "sample")
        found = [r["link"] for r in links.orderBy("pos").limit(5).collect()]
        out["sample"] = {"list_selector": selector, "links_count": links.count(), "links": found}
        if not found:
            first = zero_links(start, selector).first()
            out["sample"]["diagnostics"] = first.asDict(True) if first else {"reason": "not_landed"}
    return out


def zero_links(pages: DataFrame, selector: str, *, html: str = "html", url: str = "url") -> DataFrame:
    """Of each page on which a selector finds no link: (url, reason, html_chars, anchors, script_urls), from one reading of it."""
    read = fused.read(pages.select(url, html), {"_links": fused.n_links(selector), "anchors": fused.Extractor("long", pa.int64(), lambda p: len(dom.select(p.root, "a[href]")))}, html=html, url=url)
    chars, scripts = F.length(F.coalesce(F.col(html), F.lit(""))), F.size(extract.script_url_list(F.coalesce(F.col(html), F.lit(""))))
    return read.filter("_links = 0").select(url, F.lit("selector_zero_match").alias("reason"), chars.alias("html_chars"), "anchors", scripts.cast("long").alias("script_urls"))


def spec_faults(spec) -> list[str]:
    """What a specification lacks."""
    return [fault for fault, holds in SPEC_RULES if not holds(spec)] if isinstance(spec, dict) else ["spec must be a JSON object"]


def spec_hits(spec: dict, pages: DataFrame, *, html: str = "html", url: str = "url") -> DataFrame:
    """(url, links, hits, score): of each page the links and the values of each field that the specification finds.

    score is the share of its rules, the list's link and each field, that find something.
    """
    faults = spec_faults(spec)
    if faults:
        raise ValueError("; ".join(faults))
    fields = spec["detail"]
    rules = {"": spec["list"]["item_link"], **{f: r if isinstance(r, str) else r[0] for f, r in fields.items()}}
    read = extract.fields_of(pages.select(url, html), rules, html=html, url=url)
    count = lambda k: F.size(F.filter(F.col("fields")[k], lambda v: v != ""))
    hits = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[count(f) for f in fields]))
    passed = sum(((count(k) > 0).cast("int") for k in fields), (count("") > 0).cast("int"))
    return read.select(url, count("").alias("links"), hits.alias("hits"), F.round(passed / (1 + len(fields)), 3).alias("score"))


def validate_spec(spec: dict, lists: DataFrame, details: DataFrame | None = None) -> dict:
    """(ok, issues, score) of a specification on landed list and detail pages together."""
    issues = spec_faults(spec)
    if issues:
        return {"ok": False, "issues": issues, "score": 0.0}
    links = spec_hits(spec, lists).agg(F.coalesce(F.sum("links"), F.lit(0)).alias("n")).first()["n"]
    fields = list(spec["detail"])
    hits = dict.fromkeys(fields, 0)
    if details is not None:
        found = spec_hits(spec, details)
        hits = found.agg(*[F.coalesce(F.sum(F.col("hits")[f]), F.lit(0)).alias(f) for f in fields]).first().asDict()
    issues += [] if links else ["list.item_link matched 0 links"]
    issues += [f"detail.{f} matched 0 values" for f in fields if details is not None and not hits[f]]
    return {"ok": not issues, "issues": issues, "links": links, "hits": hits, "score": round((bool(links) + sum(bool(n) for n in hits.values())) / (1 + len(fields)), 3)}


def detail_samples(pages: DataFrame, fields: list[str], most: int = 3, *, html: str = "html", url: str = "url") -> DataFrame:
    """(field, pages, selector, votes, agreement): over landed detail pages the selector that most put first for each field."""
    top = extract.selector_candidates(pages, fields, html=html, url=url, most=most)
    total = top.groupBy("field").agg(F.count_distinct(url).alias("pages"))
    first = top.filter("rank = 0")
    votes = first.groupBy("field", "selector").agg(F.count_distinct(url).alias("votes"))
    best = votes.groupBy("field").agg(F.max_by(F.struct("selector", "votes"), F.struct("votes", "selector")).alias("b"))
    return best.join(total, "field").select("field", "pages", "b.selector", "b.votes", F.round(F.col("b.votes") / F.col("pages"), 3).alias("agreement"))


class SpecStore:
    """Specifications by site, each with all its versions, as JSON text in a folder that all can reach."""

    SCHEMA = T.StructType().add("site", "string").add("version", "long").add("spec", "string").add("saved", "double")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def save(self, spec: dict, now: float | None = None) -> int:
        """Add a version and return its number, one above the last."""
        if faults := spec_faults(spec):
            raise ValueError("; ".join(faults))
        made = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = made.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(made)
        last = self._rows().filter(F.col("site") == spec["site"]).agg(F.max("version")).first()[0] if there else None
        row = (spec["site"], (last or 0) + 1, json.dumps(spec, sort_keys=True, ensure_ascii=False), time.time() if now is None else now)
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return row[1]

    def export(self, site: str, path: str, version: int | None = None) -> None:
        """A version as one JSON text file, for a crawler that runs elsewhere."""
        text = json.dumps(self.get(site, version), ensure_ascii=False, sort_keys=True)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def versions(self, site: str) -> DataFrame:
        """(version, saved, spec), the newest first."""
        return self._rows().filter(F.col("site") == site).select("version", "saved", "spec").orderBy(F.desc("version"))

    def get(self, site: str, version: int | None = None) -> dict:
        rows = self.versions(site)
        row = (rows.filter(F.col("version") == version) if version is not None else rows).first()
        if row is None:
            raise KeyError(f"{site}, version {version}")
        return json.loads(row["spec"])

    def rollback(self, site: str, version: int | None = None, now: float | None = None) -> int:
        """Save an earlier version, without a number the last but one, as the newest."""
        if version is None:
            version = max(1, self.versions(site).first()["version"] - 1)
        return self.save(self.get(site, version), now)


def draft_spec(site: str, start_urls: list[str], pages: DataFrame, fields: list[str]) -> dict:
    """A specification from landed pages: the link and the selectors that most of them put first."""
    found = {r["field"]: r["selector"] for r in detail_samples(write_out(pages, "drafted"), ["link", *fields], 1).collect()}
    return {"site": site, "start_urls": list(start_urls), "list": {"item_link": found.pop("link", "a@href")}, "detail": {f: found.get(f, "") for f in fields}}
