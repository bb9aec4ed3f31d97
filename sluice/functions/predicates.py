"""Compilers of the filter languages to columns. No SQL text is ever built from input."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.text import extract_number

IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
RESERVED = {"id", "sole_id"}
_CONDITION = re.compile(r"^([a-zA-Z_][a-zA-Z0-9_]*)\s*(>=|<=|>|<|==|!=|contains|exists)\s*(.*)$", re.DOTALL)


def identifier(name: str) -> str:
    if not IDENTIFIER.match(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def is_missing(c: Column, kind: T.DataType | None = None) -> Column:
    """Null, '', an empty array or map, or a text that says none, null or nan."""
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return c.isNull() | (F.size(c) == 0)
    if isinstance(kind, T.StructType):
        return c.isNull()
    text = F.trim(F.lower(c.cast("string")))
    return c.isNull() | (c.cast("string") == "") | text.isin("none", "null", "nan")


def _compare(left: Column, op: str, right) -> Column:
    return {"=": left == right, "!=": left != right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]


def where(spec: str | dict | list | None, schema: T.StructType) -> Column:
    """JSON conditions joined by AND: {field: value, ...} or [{field, op, value}, ...].

    LIKE looks for the value as it is, anywhere, ASCII letters in either case. Values are compared as the
    column's declared type. Raises ValueError for unknown fields and operators and for anything but JSON.
    """
    if spec is None or spec == "":
        return F.lit(True)
    if isinstance(spec, str):
        try:
            spec = json.loads(spec)
        except json.JSONDecodeError as e:
            raise ValueError("conditions are JSON, not SQL") from e
    items = [{"field": k, "op": "=", "value": v} for k, v in spec.items()] if isinstance(spec, dict) else spec
    if not isinstance(items, list) or not all(isinstance(i, dict) for i in items):
        raise ValueError("conditions are an object or a list of objects")
    out = F.lit(True)
    for item in items:
        field, op, value = identifier(str(item.get("field", ""))), str(item.get("op", "=")).upper(), item.get("value")
        if field not in schema.fieldNames():
            raise ValueError(f"no such field: {field}")
        kind = schema[field].dataType
        if op == "LIKE":
            raw = "" if value is None else str(value)
            fold = "abcdefghijklmnopqrstuvwxyz"
            low = lambda c: F.translate(c, fold.upper(), fold)
            hit = F.contains(low(F.col(field).cast("string")), F.lit("".join(c.lower() if c.isascii() else c for c in raw)))
        elif op in ("=", "!=", ">", ">=", "<", "<="):
            hit = _compare(F.col(field), op, F.lit(value).cast(kind) if value is not None else F.lit(None))
        else:
            raise ValueError(f"no such operator: {op}")
        out = out & F.coalesce(hit, F.lit(False))
    return out


def condition(text: str, schema: T.StructType) -> Column:
    """`field op value`: numbers compare by the first number of a text, == and != as text, contains and exists."""
    text = (text or "").strip()
    if not text:
        return F.lit(True)
    m = _CONDITION.match(text)
    if not m:
        raise ValueError(f"not a condition: {text!r}")
    field, op, raw = m.groups()
    there = field in schema.fieldNames()
    c = F.col(field) if there else F.lit(None).cast("string")
    kind = schema[field].dataType if there else None
    if op == "exists":
        empty = (F.size(c) == 0) if isinstance(kind, (T.ArrayType, T.MapType)) else (c.cast("string") == "")
        return F.coalesce(c.isNotNull() & ~empty, F.lit(False))
    want = raw.strip().strip("\"'")
    said = c.cast("string")
    if op == "contains":
        return F.coalesce(F.contains(F.coalesce(said, F.lit("")), F.lit(want)), F.lit(False))
    if op in ("==", "!="):
        same = F.coalesce(said, F.lit("None")) == want
        return same if op == "==" else ~same
    left, right = extract_number(c), extract_number(F.lit(want))
    return F.coalesce(_compare(left, op, right), F.lit(False))


def select_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key by an explicit order: what keeps results stable where dropDuplicates does not."""
    n = "_first_of_key"
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col(n) == 1).drop(n)
