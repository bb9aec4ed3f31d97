"""Every query of the catalogue against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluice.functions.urls import canonical_url
from sluice.operators import frontier
from sluice.plans import catalog, catalog_search  # noqa: F401  (the second adds its queries to the first)
from tests.conftest import SF


def plain(v) -> str:
    v = v.tolist() if hasattr(v, "tolist") else v
    if isinstance(v, (list, tuple)):
        return repr([plain(x) for x in v])
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return ""
    return str(int(v)) if isinstance(v, (bool, float)) and v == int(v) else str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def test_pipeline_and_crawl_take_all_pages(spark):
    pages = [(r["u"], "<h1>" in r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").select(canonical_url(F.col("url")).alias("u"), "html").collect()]
    reached = catalog.QUERIES["crawl_levels"](spark, SF).collect()
    assert {u for u, _ in pages if u} == {r["url"] for r in reached if r["depth"] == 0 and r["found"]}
    run = [r["url"] for r in catalog.QUERIES["pipeline_run"](spark, SF).collect()]
    assert len(run) == len(set(run)) and set(run) == {u for u, titled in pages if u and titled}


def test_frontier_hands_out_all_at_once(spark):
    urls = spark.createDataFrame([(f"http://h.example/{i}", i) for i in range(frontier.MOST_LEASED + 50)], "url string, pos long")
    rows, _ = frontier.add_urls(spark.createDataFrame([], frontier.SCHEMA), urls, 1.0, order="pos")
    batch = frontier.next_batch(rows, 2.0, None)
    assert batch.count() == frontier.MOST_LEASED + 50 and frontier.lease(rows, batch, 2.0, most=None).filter("status = 'running'").count() == frontier.MOST_LEASED + 50


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, db):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.SQL:
        assert len(got.columns)
        return
    want = db.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)
