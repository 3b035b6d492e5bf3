"""Helpers shared by the corpus operators: shared folder, shipped functions, text buffers, components."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII whitespace, the separators of every "word" here unless an operator says otherwise.
SPACES = " \t\n\x0b\x0c\r"
ROOT = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, of the session or of its context; without one, an error.

    A folder of the driver's own is no substitute on a cluster, so none is made up, except where the whole of Spark
    runs in one process (a local master, as in tests).
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "ragweave-shared")
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder. It is deleted when the driver's Python ends; see clear()."""
    path = f"{shared_dir(spark)}/ragweave-{spark.sparkContext.applicationId}"
    if path not in _cleared:
        _cleared.add(path)
        atexit.register(_removed_at_end, spark, path)
    return path


_cleared: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    where = jvm.org.apache.hadoop.fs.Path(path)
    # a stopped context has no configuration of its own
    where.getFileSystem(context.hadoopConfiguration() if context else jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)


def _removed_at_end(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        _remove(spark, path)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; frames that still read them fail afterwards."""
    _remove(spark, own_dir(spark))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the files of cut() frames that nothing reads any more."""
    for df in frames:
        _remove(df.sparkSession, df.cut_path)


def shipped(module: str, name: str, *args):
    """A closure that finds the named function on the executor, so that its module-level caches outlive a task."""
    root = ROOT

    def run(batches):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.insert(0, root)
        return getattr(importlib.import_module(module), name)(batches, *args)

    return run


def named(column: str) -> Column:
    """The column of that very name, dots and other marks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id, null included, is in ids; whatever other columns docs has, they stay."""
    other = "_" * (1 + max(map(len, docs.columns)))  # longer than any name there
    return docs.join(ids.select(F.col("doc_id").alias(other)).distinct(), F.col(other).eqNullSafe(docs["doc_id"]), "left_anti")


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column as UTF-8; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offs is not None and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def trimmed(batches):
    """The batches; what the work on one has freed goes back to the system before the next is read, and at the end."""
    import ctypes

    give_back = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        give_back(0)


def given_back() -> None:
    """Freed memory of this process goes back to the system."""
    import ctypes

    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def texts_of(column: pa.Array) -> list[bytes]:
    raw, offsets = buffer_of(column)
    view, ends = raw.tobytes(), offsets.tolist()
    return [view[s:e] for s, e in zip(ends, ends[1:])]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most `most` bytes each; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def joined_by(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str, total: int, most: int = 100_000, least: int = 1000) -> DataFrame:
    """rows joined (inner) to keyed, one row for each key; `weight` is the number of rows that the key has there.

    A key of more than `least` rows and of more than one `most`-th of the `total` is hot. There are at most `most` of
    those, so they are broadcast and their rows stay where they are; the others meet in a shuffle, in which no key is
    large.
    """
    limit = max(least, total // most)
    hot, cold = keyed.where(F.col(weight) > limit), keyed.where(F.col(weight) <= limit)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


#: An odd multiplier and its inverse modulo 2**64, for hashes of byte strings by prefix sums.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept for the process."""
    held = _powers.get(base)
    if held is None or len(held) <= n:
        out = np.empty(max(n + 1, 1 << 16), np.uint64)
        out[0] = 1
        out[1:] = np.uint64(base)
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
        _powers[base] = held = out
    return held[: n + 1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def prefix_sums(raw: np.ndarray, base: int = BASE) -> np.ndarray:
    """out[i]: the polynomial of raw[:i]."""
    out = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(base, len(raw))[: len(raw)], out=out[1:])
    return out


def ranges_hashed(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hashes of raw[start:end], equal for equal bytes wherever they stand."""
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        h = (sums[end] - sums[start]) * powers(inverse, len(sums))[start]
        return mixed(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def lowered(raw: np.ndarray) -> np.ndarray:
    """Only A-Z; the bytes of other letters stay."""
    return _LOWER[raw]


def words_in(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each run of bytes that are not ASCII whitespace; a run never crosses rows."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_SPACE[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    begins[cuts] |= word[cuts]
    ends = np.empty(n, bool)
    ends[-1] = word[-1]
    ends[:-1] = word[:-1] & (~word[1:] | begins[1:])
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def crc32_text(column: Column) -> Column:
    return F.crc32(column.cast("string"))


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(v, root) for each vertex of edges (a, b): root is the least vertex that it reaches.

    Alternates large-star and small-star steps; each is an aggregate with map-side combine and an equi-join
    that adaptive execution may split, so no vertex's links have to meet in one task. Each round is cut to the
    shared folder. A vertex that has no link to another has no row.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-e")
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-l")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = cut(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-s")
        drop(e, large)
        e = after
    return e.select(F.col("u").alias("v"), F.col("v").alias("root")).union(e.select("v", F.col("v").alias("root")).distinct())
