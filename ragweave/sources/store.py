"""Small documents in any store that Spark can reach, and tables held in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import contextlib
import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _at(spark, path)
    return bool(store.exists(where))


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none of a folder that is not there."""
    store, where = _at(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(where)) if store.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    store, where = _at(spark, path)
    store.delete(where, True)


_held: set[str] = set()


def held_dir(spark: SparkSession) -> str:
    """This application's part of the folder that spark.checkpoint.dir names; deleted when the driver's Python ends.

    Without that setting a local master, as in tests, uses the temporary folder; any other master is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "ragweave-shared")
    path = f"{found.rstrip('/')}/held-{spark.sparkContext.applicationId}"
    if path not in _held:
        _held.add(path)
        atexit.register(_dropped, spark, path)
    return path


def _dropped(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        context = spark.sparkContext._jsc
        where.getFileSystem(context.hadoopConfiguration() if context else spark._jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)


def held(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back: what is random or costly in it stays as it is, and lost executors lose nothing."""
    path = f"{held_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Whole or not at all: written beside its place and moved there."""
    store, part = _at(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = store.create(part, True)
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
    finally:
        out.close()
    _, where = _at(spark, path)
    if not store.rename(part, where):  # some stores do not move onto a file
        store.delete(where, False)
        store.rename(part, where)


def put_json(spark: SparkSession, path: str, document: dict) -> None:
    put_text(spark, path, json.dumps(document, ensure_ascii=False, sort_keys=True, indent=2) + "\n")


def read_json(spark: SparkSession, path: str) -> dict:
    store, where = _at(spark, path)
    stream = store.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()
