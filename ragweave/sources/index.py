"""An exact inner-product index as tables: shards of chunks with vectors, their manifests, one merged index."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragweave.functions import tokens as K
from ragweave.operators.ledger import dense, merged_shards

from .store import exists, held, put_json, read_json

KIND = "exact inner product"


def _stem(shard: int, shards: int) -> str:
    return f"shard-{shard:02d}-of-{shards:02d}"


def build_shards(records: DataFrame, encode: Callable[[DataFrame], DataFrame], path: str, shards: int, size: int = 256, overlap: int = 32, tokenizer=None) -> list[dict]:
    """Manifests of the shards of records (record_id, title, text, line_no), written below path.

    line_no is that of readers.corpus(), from which records get their number without gaps (`document`); a record's shard
    is its number modulo `shards`. encode: from (chunk_id, text) to chunk_id, vec. Whatever the number of shards, records are read and chunked
    once and written once, into a folder of this call; a shard's manifest, which names its part of that folder, is
    written last, so a shard whose manifest stands is complete and is not built again.
    """
    spark = records.sparkSession
    open_ = [s for s in range(shards) if not exists(spark, f"{path}/{_stem(s, shards)}.json")]
    if open_:
        placed = dense(records.select("record_id", "title", "text", "line_no"), "line_no", "document").withColumn("shard", F.pmod("document", F.lit(shards)).cast("int"))
        own = placed.where(F.col("shard").isin(*open_)).select(F.struct(F.col("record_id").alias("source_doc_id"), "title", "line_no", "document", "shard").alias("_k"), "text")
        made = held(K.chunks(own, size, overlap, tokenizer, "_k", key=F.col("_k.source_doc_id")).select("_k.*", *K.CHUNK), "chunks")
        joined = made.join(encode(made.select("chunk_id", "text")).select("chunk_id", "vec"), "chunk_id")
        folder = f"build-{uuid.uuid4().hex}"
        joined.withColumn("part", F.col("shard")).write.partitionBy("part").parquet(f"{path}/{folder}")
        rows = spark.read.schema(joined.schema).option("recursiveFileLookup", "true").parquet(f"{path}/{folder}")
        found = rows.groupBy("shard").agg(F.count("*").alias("chunks"), F.count_distinct("source_doc_id").alias("documents"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most"), F.count_if(F.col("vec").isNull()).alias("bare"))
        by_shard = {r["shard"]: r for r in found.collect()}  # a row for each shard
        for s in open_:
            r = by_shard.get(s)
            if r and (r["bare"] or r["least"] != r["most"]):
                raise ValueError(f"vectors of {_stem(s, shards)} are missing or differ in length")
        for s in open_:
            r = by_shard.get(s)
            put_json(spark, f"{path}/{_stem(s, shards)}.json", {"shard": s, "shards": shards, "chunks": r["chunks"] if r else 0, "documents": r["documents"] if r else 0, "dimension": r["most"] if r else 0, "chunk_size": size, "overlap": overlap, "rows": f"{folder}/part={s}" if r else None})
    return [read_json(spark, f"{path}/{_stem(s, shards)}.json") for s in range(shards)]


def merge_shards(spark: SparkSession, path: str, shards: int) -> dict:
    """The manifest of the merged index: chunks with row_id 0..n-1 in order of shard, document and chunk, each source once.

    Every shard must be complete, dimensions must agree, a chunk must not come twice, and rows must be as many as the
    manifests say.
    """
    missing = [s for s in range(shards) if not exists(spark, f"{path}/{_stem(s, shards)}.json")]
    if missing:
        raise FileNotFoundError(f"incomplete shards: {missing}")
    manifests = [read_json(spark, f"{path}/{_stem(s, shards)}.json") for s in range(shards)]
    dimensions = {m["dimension"] for m in manifests if m["chunks"]}
    if len(dimensions) > 1:
        raise ValueError(f"dimensions disagree: {sorted(dimensions)}")
    folders = [f"{path}/{m['rows']}" for m in manifests if m["rows"]]
    if not folders:
        raise ValueError("no shard has a chunk")
    rows = spark.read.option("recursiveFileLookup", "true").parquet(*folders)
    merged_shards(rows, "shard", ["document", "chunk_no"], "chunk_id").drop("title").write.mode("overwrite").parquet(f"{path}/chunks")
    rows.groupBy("source_doc_id").agg(F.min_by("title", F.struct("shard", "document")).alias("title")).write.mode("overwrite").parquet(f"{path}/sources")
    chunks = spark.read.parquet(f"{path}/chunks").count()
    if chunks != sum(m["chunks"] for m in manifests):
        raise ValueError("the merged rows are not as many as the manifests say")
    manifest = {"kind": KIND, "chunks": chunks, "sources": spark.read.parquet(f"{path}/sources").count(), "dimension": next(iter(dimensions), 0), "shards": shards}
    put_json(spark, f"{path}/index.json", manifest)
    return manifest


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(chunks, sources, manifest); anything but a complete exact inner-product index is an error."""
    manifest = read_json(spark, f"{path}/index.json")
    if manifest.get("kind") != KIND:
        raise ValueError(f"not an index for {KIND}: {json.dumps(manifest)}")
    return spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/sources"), manifest
