"""Tables with registered schemas: validation, identity, first-writer-wins appends, paged reads and exports.

A table is a Parquet folder <root>/<db>/<table>; its schema is JSON beside it. An append is idempotent:
records are validated, reduced to the first of each identity in input order, and those whose identity is
stored already are left out by an anti join.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.predicates import RESERVED, identifier, where
from sluice.session import fresh, write_out

TYPES = {"TEXT": "string", "INTEGER": "bigint", "REAL": "double", "BLOB": "binary", "NUMERIC": "string"}


@dataclass(frozen=True)
class TableSchema:
    """columns by name to one of TYPES; required and unique columns; strict: undeclared columns are errors."""

    columns: dict[str, str]
    required: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    indexes: tuple[tuple[str, ...], ...] = ()
    strict: bool = True

    @staticmethod
    def parse(spec: dict | str) -> TableSchema:
        spec = json.loads(spec) if isinstance(spec, str) else spec
        columns = spec.get("columns") or spec.get("fields")
        if not isinstance(columns, dict) or not columns:
            raise ValueError("a schema needs columns")
        kinds = {}
        for name, kind in columns.items():
            kind = str(kind or "TEXT").upper()
            if kind not in TYPES:
                raise ValueError(f"column {name}: no such type {kind}")
            if identifier(name) in RESERVED:
                raise ValueError(f"column {name} is reserved")
            kinds[name] = kind
        unique = spec.get("unique") or spec.get("unique_fields") or ()
        unique = (unique,) if isinstance(unique, str) else tuple(unique)
        indexes = tuple((i,) if isinstance(i, str) else tuple(i) for i in spec.get("indexes", ()))
        required = tuple(spec.get("required", ()))
        if unknown := [f for f in (*required, *unique, *(f for i in indexes for f in i)) if f not in kinds]:
            raise ValueError(f"undeclared columns: {unknown}")
        return TableSchema(kinds, required, unique, indexes, bool(spec.get("strict", True)))

    def to_json(self) -> str:
        return json.dumps({"columns": self.columns, "required": self.required, "unique": self.unique, "indexes": self.indexes, "strict": self.strict})

    def struct(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join([*(f"`{n}` {TYPES[k]}" for n, k in self.columns.items()), "sole_id string"]))


def infer_type(kind: T.DataType) -> str:
    if isinstance(kind, (T.BooleanType, T.IntegralType)):
        return "INTEGER"
    return "REAL" if isinstance(kind, (T.FractionalType,)) else "TEXT"


def as_text(df: DataFrame, name: str) -> Column:
    nested = isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType))
    return F.to_json(F.col(name)) if nested else F.col(name).cast("string")


def coerce(df: DataFrame, name: str, kind: str) -> Column:
    """The column as its declared type; a value that can't be is null."""
    if kind == "INTEGER" and isinstance(df.schema[name].dataType, T.BooleanType):
        return F.col(name).cast("bigint")
    return as_text(df, name) if kind in ("TEXT", "NUMERIC") else F.expr(f"try_cast(`{identifier(name)}` as {TYPES[kind]})")


def prepare(df: DataFrame, schema: TableSchema | None, errors: str = "errors") -> DataFrame:
    """Coerced records with an array of what is wrong with each: missing:x, unknown:x or type:x."""
    if not schema:
        return df.select(*[coerce(df, c, infer_type(df.schema[c].dataType)).alias(identifier(c)) for c in df.columns], F.array().cast("array<string>").alias(errors))
    wrong = [F.when(F.col(c).isNull() | (as_text(df, c) == "") if c in df.columns else F.lit(True), F.lit(f"missing:{c}")) for c in schema.required]
    extra = [c for c in df.columns if c not in schema.columns]
    if schema.strict:
        wrong += [F.when(F.col(c).isNotNull(), F.lit(f"unknown:{c}")) for c in extra]
    wrong += [F.when(F.col(c).isNotNull() & coerce(df, c, k).isNull(), F.lit(f"type:{c}")) for c, k in schema.columns.items() if c in df.columns]
    out = [coerce(df, c, k).alias(c) if c in df.columns else F.lit(None).cast(TYPES[k]).alias(c) for c, k in schema.columns.items()]
    if not schema.strict:
        out += [coerce(df, c, infer_type(df.schema[c].dataType)).alias(identifier(c)) for c in extra]
    return df.select(*out, F.array_compact(F.array(*wrong)).alias(errors) if wrong else F.array().cast("array<string>").alias(errors))


def sole_id(df: DataFrame, schema: TableSchema | None) -> Column:
    """MD5 of the unique columns as JSON, or of url, handle and the first 200 characters of the record's JSON.

    The JSON has its keys sorted and no spaces; nulls are written, so null and absent are one.
    """
    names = sorted(schema.unique if schema and schema.unique else df.columns)
    text = F.to_json(F.struct(*[F.col(c) for c in names]), {"ignoreNullFields": "false"})
    if schema and schema.unique:
        return F.md5(text)
    lead = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in ("url", "handle")]
    return F.md5(F.concat(*lead, F.substring(text, 1, 200)))


def first_by_identity(df: DataFrame, key: str, order: Column) -> DataFrame:
    """Of the rows of each key the first in order, by a sum that takes one row a key and task, however many a key has."""
    row, of = fresh("row", df), fresh("of", df)
    return df.groupBy(F.col(key).alias(of)).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), order).alias(row)).select(f"{row}.*")


def new_records(stored: DataFrame | None, batch: DataFrame, schema: TableSchema | None, order: Column) -> DataFrame:
    """Of a prepared batch the records, with sole_id, that are first in it and not stored yet."""
    keyed = first_by_identity(batch.withColumn("sole_id", sole_id(batch, schema)), "sole_id", order)
    return keyed if stored is None else keyed.join(stored.select("sole_id"), "sole_id", "left_anti")


@dataclass
class Store:
    """Tables under a folder that all executors reach."""

    spark: SparkSession
    root: str
    counts: dict = field(default_factory=dict)

    def _path(self, db: str, table: str) -> str:
        return f"{self.root}/{identifier(db)}/{identifier(table)}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, db: str, table: str) -> bool:
        fs, p = self._fs(self._path(db, table) + "/data")
        return fs.exists(p)

    def register(self, db: str, table: str, schema: dict | str) -> TableSchema:
        """Keep a schema and create the table, empty, if it isn't there."""
        parsed = TableSchema.parse(schema)
        self.spark.createDataFrame([(parsed.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(self._path(db, table) + "/schema")
        if not self.exists(db, table):
            self.spark.createDataFrame([], parsed.struct()).write.parquet(self._path(db, table) + "/data")
        return parsed

    def schema(self, db: str, table: str) -> TableSchema | None:
        fs, p = self._fs(self._path(db, table) + "/schema")
        return TableSchema.parse(self.spark.read.text(str(p)).first()[0]) if fs.exists(p) else None

    def table(self, db: str, table: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(self._path(db, table) + "/data")

    def save(self, df: DataFrame, db: str, table: str, schema: dict | None = None, order: str | None = None, atomic: bool = True) -> dict[str, int]:
        """Append new records; returns saved, skipped and errors. Any invalid record stops the whole batch.

        Spark's commit makes one append all or nothing. atomic=False appends valid records only.
        """
        parsed = TableSchema.parse(schema) if schema else self.schema(db, table)
        n = fresh("n_order", df)
        numbered = df.withColumn(n, F.col(order) if order else F.monotonically_increasing_id())
        ready = prepare(numbered.drop(n), parsed).columns
        checked = prepare(numbered, TableSchema({**parsed.columns, n: "INTEGER"}, parsed.required, parsed.unique, (), parsed.strict) if parsed else None)
        state = checked.agg(F.count(F.lit(1)).alias("rows"), F.sum((F.size("errors") > 0).cast("long")).alias("bad"), F.first(F.when(F.size("errors") > 0, F.col("errors")), True).alias("what")).first()
        if state["bad"] and atomic:
            raise ValueError(f"{state['bad']} invalid records, such as {list(state['what'])}")
        valid = checked.filter(F.size("errors") == 0).select(*[c for c in ready if c != "errors"], n)
        stored = self.table(db, table) if self.exists(db, table) else None
        keyed = valid.withColumn("sole_id", sole_id(valid.drop(n), parsed))
        fresh_rows = first_by_identity(keyed, "sole_id", F.col(n)).drop(n)
        if stored is not None:
            fresh_rows = fresh_rows.join(stored.select("sole_id"), "sole_id", "left_anti")
        # Written out first: the rows are told apart once, and it is their number that counts, not that of the whole table.
        new = write_out(fresh_rows, "new")
        saved = new.count()
        new.write.mode("append").parquet(self._path(db, table) + "/data")
        return {"saved": saved, "skipped": state["rows"] - (state["bad"] or 0) - saved, "errors": state["bad"] or 0}

    def query(self, db: str, table: str, spec=None, limit: int = 20, offset: int = 0, order: tuple[str, ...] = ("sole_id",)) -> tuple[int, DataFrame]:
        """(total, page) of the records that meet the conditions, in a stated order."""
        df = self.table(db, table)
        found = df.filter(where(spec, df.schema))
        return found.count(), found.orderBy(*order).offset(offset).limit(limit)

    def export(self, db: str, table: str, path: str, kind: str = "csv", spec=None) -> None:
        df = self.table(db, table)
        out = df.filter(where(spec, df.schema)).write.mode("overwrite")
        if kind == "csv":
            out.option("header", "true").csv(path)
        elif kind in ("json", "jsonl"):
            out.json(path)
        else:
            raise ValueError(f"no such format: {kind}")

    def tables(self) -> DataFrame:
        """(db, table, n): the catalogue with row counts."""
        fs, p = self._fs(self.root)
        rows = []
        for db in fs.listStatus(p) if fs.exists(p) else []:
            for t in fs.listStatus(db.getPath()):
                names = db.getPath().getName(), t.getPath().getName()
                if self.exists(*names):
                    rows.append((*names, self.table(*names).count()))
        return self.spark.createDataFrame(rows, "db string, table string, n long")


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """The union by name; columns that either side lacks are null."""
    return old.unionByName(new, allowMissingColumns=True)


def title_dict(df: DataFrame, title: str, url: str, order: Column) -> DataFrame:
    """(title, url, pos): a later record of a title gives its url, the first one its place."""
    return df.groupBy(F.col(title).alias("title")).agg(F.max_by(F.col(url), order).alias("url"), F.min(order).alias("pos"))


def group_by_source(df: DataFrame, source: Column) -> DataFrame:
    """(source, n): sizes of the groups in which records are shown."""
    return df.groupBy(F.coalesce(source, F.lit("items")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
