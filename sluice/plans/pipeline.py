"""The pipeline language: a JSON list of steps, compiled to lazy DataFrames. Only sinks run jobs.

Steps: crawl_list, crawl_lists, frontier_add, frontier_next, crawl_products (crawl_product), filter, save,
save_json. Links are set anew by each step that makes them. Pages come from a PageSource, whole.
"""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.predicates import condition
from sluice.functions.urls import canonical_url, validate_url
from sluice.operators import extract, frontier
from sluice.operators.store import Store
from sluice.session import write_out
from sluice.sources.pages import PageSource

LINKS = "url string, text string, source_list_url string, pos long"


def render(value, variables: dict):
    """The value with {{name}} replaced in all its texts; a text that is one variable alone takes its value."""
    if isinstance(value, str):
        if (m := re.fullmatch(r"\{\{\s*(\w+)\s*\}\}", value)) and m[1] in variables:
            return variables[m[1]]
        return re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: str(variables.get(m[1], m[0])), value)
    if isinstance(value, dict):
        return {k: render(v, variables) for k, v in value.items()}
    return [render(v, variables) for v in value] if isinstance(value, list) else value


@dataclass
class State:
    """What a run has made so far."""

    links: DataFrame
    records: DataFrame | None = None
    frontier: DataFrame | None = None
    results: list[dict] = field(default_factory=list)


class Pipeline:
    """A parsed pipeline."""

    def __init__(self, spec: dict):
        steps = spec.get("steps")
        if not isinstance(steps, list) or not steps:
            raise ValueError("a pipeline needs steps")
        for s in steps:
            if (s.get("step") or s.get("action")) not in STEPS:
                raise ValueError(f"no such step: {s.get('step') or s.get('action')}")
        self.spec = spec

    @staticmethod
    def from_json(text: str, variables: dict | None = None) -> Pipeline:
        spec = json.loads(text)
        if not isinstance(spec, dict):
            raise ValueError("a pipeline is a JSON object")
        return Pipeline(render(spec, variables or {}))

    def run(self, spark: SparkSession, pages: PageSource, store: Store | None = None, now: float | None = None) -> State:
        state = State(spark.createDataFrame([], LINKS))
        for step in self.spec["steps"]:
            STEPS[step.get("step") or step.get("action")](state, step, Context(spark, pages, store, now if now is not None else time.time(), self.spec))
        return state


@dataclass
class Context:
    spark: SparkSession
    pages: PageSource
    store: Store | None
    now: float
    spec: dict


def _most(step: dict, otherwise: int) -> int:
    return int(step.get("max_items") or step.get("max_links") or otherwise)


def _collect_links(state: State, step: dict, c: Context, lists: list[str]) -> None:
    selector = step.get("selector") or step.get("link_selector")
    if not selector or not lists:
        raise ValueError("a list step needs its URLs and a selector")
    asked = c.spark.createDataFrame(list(enumerate(lists)), "list_no int, url string").filter(validate_url(F.col("url")) == "")
    found = extract.links(c.pages.fetch(asked, whole=True).filter("ok").select("list_no", "url", "html"), selector)
    first = found.groupBy("link").agg(F.min(F.struct("list_no", "pos", "text", F.col("url").alias("source"))).alias("f"))
    ranked = first.orderBy("f.list_no", "f.pos").limit(_most(step, 100))
    state.links = ranked.select(F.col("link").alias("url"), "f.text", F.col("f.source").alias("source_list_url"), (F.col("f.list_no").cast("long") * (1 << 32) + F.col("f.pos")).alias("pos"))


def crawl_list(state: State, step: dict, c: Context) -> None:
    _collect_links(state, step, c, [step["url"]])


def crawl_lists(state: State, step: dict, c: Context) -> None:
    _collect_links(state, step, c, list(step.get("urls") or ()))


def frontier_add(state: State, step: dict, c: Context) -> None:
    if step.get("source") == "pages":
        urls = c.pages.urls().select("url", F.monotonically_increasing_id().alias("pos"))
    else:
        urls = state.links.select("url", "pos") if step.get("source", "links") == "links" and not step.get("urls") else c.spark.createDataFrame([(u, i) for i, u in enumerate(step.get("urls", ()))], "url string, pos long")
    before = state.frontier if state.frontier is not None else c.spark.createDataFrame([], frontier.SCHEMA)
    options = {"priority": int(step.get("priority", 0)), "kind": step.get("kind", "detail"), "depth": int(step.get("depth", 0)), "parent_url": step.get("parent_url", ""), "payload_json": json.dumps(step.get("payload", {}), sort_keys=True)}
    state.frontier, _ = frontier.add_urls(before, urls, c.now, order="pos", **options)


def frontier_next(state: State, step: dict, c: Context) -> None:
    if state.frontier is None:
        raise ValueError("frontier_next comes after frontier_add")
    now = write_out(state.frontier, "frontier")
    most = None if step.get("limit") == "all" else int(step.get("limit", 20))
    batch = frontier.next_batch(now, c.now, most, step.get("domain", ""), float(step.get("lease_seconds", 900)))
    batch = write_out(batch, "batch")
    state.frontier = frontier.lease(now, batch, c.now, step.get("worker_id", "pipeline"), most=most)
    state.links = batch.select("url", F.col("kind").alias("text"), F.lit(None).cast("string").alias("source_list_url"), F.monotonically_increasing_id().alias("pos"))


def crawl_products(state: State, step: dict, c: Context) -> None:
    fields = step.get("fields")
    if not isinstance(fields, dict) or not fields:
        raise ValueError("crawl_products needs fields")
    wanted = state.links.orderBy("pos").limit(int(step["max_items"])) if step.get("max_items") else state.links
    got = c.pages.fetch(wanted, whole=True)
    if step.get("stop_on_error") and not got.filter("not ok").isEmpty():
        raise ValueError("a page could not be read")
    read = extract.fields_of(got.filter("ok"), fields)
    one = lambda k: F.when(F.size(F.col("fields")[k]) == 0, F.lit("")).when(F.size(F.col("fields")[k]) == 1, F.col("fields")[k][0]).otherwise(F.to_json(F.col("fields")[k]))
    state.records = read.select("url", *[one(k).alias(k) for k in fields if k != "url"], "source_list_url", "pos")


def keep_matching(state: State, step: dict, c: Context) -> None:
    if state.records is not None:
        state.records = state.records.filter(condition(step.get("condition", ""), state.records.schema))


def _plain(state: State) -> DataFrame:
    if state.records is None:
        raise ValueError("there are no records to save")
    return state.records.drop("source_list_url")


def save(state: State, step: dict, c: Context) -> None:
    if c.store is None:
        raise ValueError("save needs a store")
    db, table = step.get("db") or step.get("db_name") or c.spec.get("db") or "crawler_data", step.get("table") or c.spec.get("table") or "items"
    df = _plain(state)
    counts = c.store.save(df.drop("pos"), db, table, step.get("schema"), atomic=bool(step.get("atomic", True)))
    state.results.append({"step": "save", "db": db, "table": table, **counts})


def save_json(state: State, step: dict, c: Context) -> None:
    path = step.get("path") or step.get("filename", "pipeline_output.json")
    _plain(state).orderBy("pos").drop("pos").write.mode("overwrite").json(path)
    state.results.append({"step": "save_json", "path": path})


STEPS = {"crawl_list": crawl_list, "crawl_lists": crawl_lists, "frontier_add": frontier_add, "frontier_next": frontier_next, "crawl_products": crawl_products, "crawl_product": crawl_products, "filter": keep_matching, "save": save, "save_json": save_json}


def draft(start_url: str, link_selector: str = "", fields: dict | None = None, *, output: str = "json", name: str = "output", db: str = "", table: str = "items", most: int = 100, use_frontier: bool = False) -> dict:
    """A pipeline for a list page and its details."""
    steps: list[dict] = [{"step": "crawl_list", "url": start_url, "selector": link_selector, "max_items": most}] if link_selector else [{"step": "frontier_add", "source": "urls", "urls": [start_url]}]
    if use_frontier or not link_selector:
        steps += [{"step": "frontier_add", "source": "links"}] * bool(link_selector) + [{"step": "frontier_next", "limit": most}]
    steps += [{"step": "crawl_products", "fields": fields, "max_items": most}] if fields else []
    steps += [{"step": "save", "db": db, "table": table}] if db else [{"step": "save_json", "filename": name}] if output == "json" else []
    return {"steps": steps}


# The names that a plan may give its parts by, the first that is there counts, and what parts are without one.
PLAN_PARTS = {
    "start": ("start_url", "url", "list_url"),
    "fields": ("fields", "detail_fields"),
    "selector": ("list_selector", "selector", "item_link"),
    "lists": ("category_urls",),
    "details": ("detail_urls", "urls"),
    "most": ("max_items",),
    "condition": ("filter",),
    "output": ("output",),
    "db": ("db_name",),
    "table": ("table",),
    "file": ("output_name",),
}
PLAN_DEFAULTS = {"most": 20, "output": "json", "db": "crawler_data", "table": "items", "file": "collection.json"}
# A step of the pipeline for each row whose parts are all there and whose other parts are not: its name, both, and its
# settings, by parts of the plan (as "$name") or as they are.
PLAN_STEPS: list[tuple[str, str, str, dict]] = [
    ("crawl_lists", "selector lists", "", {"urls": "$lists", "selector": "$selector", "max_items": "$most"}),
    ("crawl_list", "selector", "lists", {"url": "$start", "selector": "$selector", "max_items": "$most"}),
    ("frontier_add", "details", "selector", {"urls": "$details", "priority": 10, "kind": "detail"}),
    ("frontier_next", "details", "selector", {"limit": "$most"}),
    ("frontier_add", "start", "selector details", {"urls": "$starts", "priority": 10, "kind": "detail"}),
    ("frontier_next", "start", "selector details", {"limit": 1}),
    ("crawl_products", "fields", "", {"fields": "$fields", "max_items": "$most"}),
    ("filter", "condition", "", {"condition": "$condition"}),
    ("save", "to_db", "", {"db": "$db", "table": "$table"}),
    ("save_json", "to_json", "", {"filename": "$file"}),
]
#: Items that a plan may ask for at once, as elsewhere; None takes the plan at its word.
MOST_ITEMS = 1000


def from_plan(plan: dict, validate_only: bool = False, most_items: int | None = MOST_ITEMS) -> dict:
    """A collection plan as a pipeline: list pages or detail URLs, fields, a filter and sinks."""
    part = {k: next((plan[n] for n in names if plan.get(n)), PLAN_DEFAULTS.get(k)) for k, names in PLAN_PARTS.items()}
    part = {k: plan.get(PLAN_PARTS[k][0], v) if k in PLAN_DEFAULTS else v for k, v in part.items()}
    if not part["start"] or not isinstance(part["fields"] or {}, dict):
        raise ValueError("a plan needs start_url and fields as an object")
    most = max(1, int(part["most"]))
    part |= {"most": most if most_items is None else min(most, most_items), "starts": [part["start"]], "condition": str(part["condition"] or "")}
    part |= {"to_db": part["output"] in ("db", "both"), "to_json": part["output"] in ("json", "both") and not validate_only}
    value = lambda v: part[v[1:]] if isinstance(v, str) and v.startswith("$") else v
    there = lambda names: [part[n] for n in names.split()]
    return {"steps": [{"step": name, **{k: value(v) for k, v in settings.items()}} for name, needs, without, settings in PLAN_STEPS if all(there(needs)) and not any(there(without))]}


class Templates:
    """Named pipelines, kept as JSON text in a folder that all can reach."""

    SCHEMA = T.StructType().add("name", "string").add("description", "string").add("pipeline", "string").add("saved", "double")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, name: str, pipeline: dict, description: str = "", now: float | None = None) -> None:
        Pipeline(pipeline)
        self.spark.createDataFrame([(name, description, json.dumps(pipeline), now if now is not None else time.time())], self.SCHEMA).write.mode("append").json(self.path)

    def list(self) -> DataFrame:
        """The latest version of each template, with the names of its variables."""
        rows = self.spark.read.schema(self.SCHEMA).json(self.path)
        latest = rows.groupBy("name").agg(F.max_by(F.struct("description", "pipeline"), "saved").alias("r"), F.count(F.lit(1)).alias("versions"))
        return latest.select("name", "versions", "r.*").withColumn("variables", F.array_sort(F.array_distinct(F.regexp_extract_all("pipeline", F.lit(r"\{\{\s*(\w+)\s*\}\}"), F.lit(1)))))

    def get(self, name: str, variables: dict | None = None) -> Pipeline:
        row = self.list().filter(F.col("name") == name).first()
        if row is None:
            raise KeyError(name)
        return Pipeline.from_json(row["pipeline"], variables)


def canonical_links(links: DataFrame) -> DataFrame:
    """Links with their URLs in canonical form, each once, in order."""
    return links.withColumn("url", canonical_url(F.col("url"))).filter(F.col("url").isNotNull()).groupBy("url").agg(F.min("pos").alias("pos"))
