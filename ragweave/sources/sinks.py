"""Sinks: append-only ledgers, flattened Parquet and single documents."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ragweave.operators.ledger import resumed

from .readers import POINTER, home, ledger
from .store import delete, exists, listed, put_json


def append_ledger(rows: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Append rows as JSON lines. With keys, rows whose key the ledger has already are left out, and of equal keys one goes.

    A task's lines appear whole when its job commits, so a restart finds a key written or not at all.
    """
    spark, there = rows.sparkSession, exists(rows.sparkSession, path)
    if keys and there:
        kinds = dict(rows.dtypes)
        done = ledger(spark, path, ", ".join(f"{k} {kinds[k]}" for k in keys)).select(*keys).distinct()
        rows = rows.join(done, keys, "left_anti")
    (rows.dropDuplicates(keys) if keys else rows).write.mode("append").json(home(spark, path) if there else path)


def compacted(spark: SparkSession, path: str, schema: str, keys: list[str], expected: dict[str, object]) -> DataFrame:
    """The keys that a restart need not do again; the ledger keeps the first row of each, of the expected provenance only.

    If any row goes, the kept ones are written to a folder of their own inside the ledger, then a pointer to it, and only
    then the rows before go: at every moment the last pointer, or its absence, names rows that are whole. Malformed lines
    are an error. A ledger that is not there has no keys.
    """
    if not keys:
        raise ValueError("a restart needs a key")
    if not exists(spark, path):
        return spark.createDataFrame([], schema).select(*keys)
    rows, before = ledger(spark, path, schema), home(spark, path)
    columns = [c for c in rows.columns if c not in ("file", "line_no")]
    kept = resumed(rows, keys, ["file", "line_no"], expected)
    lines = spark.read.text(before).count()
    if kept.count() != lines:
        fresh = f"_v-{uuid.uuid4().hex}"
        kept.select(*columns).write.json(f"{path}/{fresh}")
        number = 1 + max((int(n[len(POINTER) :]) for n in listed(spark, path) if n.startswith(POINTER) and not n.endswith(".part")), default=0)
        put_json(spark, f"{path}/{POINTER}{number:09d}", {"rows": fresh})
    swept(spark, path)
    return ledger(spark, path, schema).select(*keys).distinct()


def swept(spark: SparkSession, path: str) -> None:
    """Deletes what no reader of a ledger looks at: rows and pointers before its last pointer, and what a kill left."""
    last, names = home(spark, path), listed(spark, path)
    pointers = [n for n in names if n.startswith(POINTER) and not n.endswith(".part")]
    stay = {last.rsplit("/", 1)[1], pointers[-1]} if pointers else {n for n in names if not n.startswith(("_v-", POINTER))}
    for n in names:
        if n not in stay:
            delete(spark, f"{path}/{n}")


def flattened(df: DataFrame) -> DataFrame:
    """Struct fields as columns with dotted names."""

    def leaves(schema: StructType, at: tuple[str, ...] = ()):
        for f in schema.fields:
            where = (*at, f.name)
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, where)
            else:
                yield F.col(".".join(f"`{w}`" for w in where)).alias(".".join(where))

    return df.select(*leaves(df.schema))


def write_document(path: str, document: dict) -> None:
    """One JSON document, whole or not at all."""
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(document, f, ensure_ascii=False, sort_keys=True, indent=2)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def report(rows: DataFrame, title: str, limit: int = 200) -> str:
    """A small result as Markdown; the limit is the report's size."""
    names = rows.columns
    lines = [f"# {title}", "", f"| {' | '.join(names)} |", f"|{'---|' * len(names)}"]
    return "\n".join([*lines, *(f"| {' | '.join(str(v) for v in r)} |" for r in rows.limit(limit).collect())]) + "\n"
