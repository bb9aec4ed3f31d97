"""Reading records: CSV and JSON files or texts, with their usual envelopes, event logs and URL lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.metrics import EVENT

ENVELOPES = ("records", "data", "data.records", "items")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, names from the header; a byte order mark is passed over by Spark."""
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """An array, an object, or an object around an array of records; other columns of an envelope are dropped."""
    return open_envelope(spark.read.option("multiLine", str(not lines).lower()).json(path))


def open_envelope(df: DataFrame) -> DataFrame:
    for name in ENVELOPES:
        kind: T.DataType | None = df.schema
        for step in name.split("."):
            kind = kind[step].dataType if isinstance(kind, T.StructType) and step in kind.fieldNames() else None
        if isinstance(kind, T.ArrayType):
            rows = df.select(F.explode(name).alias("value"))
            return rows.select("value.*") if isinstance(kind.elementType, T.StructType) else rows
    return df


def read_records(spark: SparkSession, path: str, kind: str = "auto") -> DataFrame:
    if kind == "auto":
        kind = "csv" if path.lower().endswith((".csv", ".tsv", ".txt")) else "jsonl" if path.lower().endswith((".jsonl", ".ndjson")) else "json"
    return read_csv(spark, path) if kind == "csv" else read_json(spark, path, kind == "jsonl")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """An event log of JSON lines; lines that are no JSON are dropped."""
    lines = spark.read.text(path).filter(F.try_parse_json("value").isNotNull())
    return lines.select(F.from_json("value", EVENT).alias("e")).select("e.*")


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def json_or_lines(text: Column) -> Column:
    """A JSON list as its elements, other JSON as one element, anything else as its non-empty lines."""
    parsed = F.try_parse_json(text)
    elements = F.from_json(text, "array<string>")
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.trim(text).startswith("[") & parsed.isNotNull(), elements).when(parsed.isNotNull(), F.array(F.trim(text))).otherwise(lines)


def candidate_urls(text: Column) -> Column:
    """URLs of a JSON list, of an object's urls or candidates, or parted by line ends and commas."""
    parsed = F.try_parse_json(text)
    named = F.coalesce(F.from_json(text, "urls array<string>, candidates array<string>")["urls"], F.from_json(text, "urls array<string>, candidates array<string>")["candidates"])
    parted = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[\r\n,]+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.trim(text).startswith("[") & parsed.isNotNull(), F.from_json(text, "array<string>")).when(F.trim(text).startswith("{") & parsed.isNotNull(), F.coalesce(named, F.array().cast("array<string>"))).otherwise(parted)
