"""Best-fit packing of documents into sequences of fixed capacity under conflicts.

Items come longest first. Open bins are held by residual capacity, and each carries bitmaps of the sources and
duplicate clusters inside it. For an item, successor search starts at the least residual that has room and goes on
to the next larger one until a compatible bin is found; if there is none, a bin opens. Rows are dealt to shards of
about `shard` items by a hash and each shard is packed by itself, so that memory stays bounded; rows that are equal in
all that counts are dealt SPREAD to a shard, so that many of them do not meet either.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shipped, texts_of

CAPACITY, SHARD, SPREAD = 2048, 8192, 64


class Bins:
    """Open bins of one shard by residual; a bitmap of residuals in use gives the successor."""

    def __init__(self, capacity: int):
        self.capacity, self.used, self.by_residual, self.bins = capacity, 0, [[] for _ in range(capacity + 1)], 0
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset). source and cluster are bits; 0 never conflicts."""
        seen = self.used >> length
        residual = length
        while seen:
            step = (seen & -seen).bit_length() - 1
            residual += step
            held = self.by_residual[residual]
            for at, b in enumerate(held):
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    del held[at]
                    if not held:
                        self.used &= ~(1 << residual)
                    return self._put(b, residual, length, source, cluster)
            seen >>= step + 1
            residual += 1
        self.sources.append(0)
        self.clusters.append(0)
        self.bins += 1
        return self._put(self.bins - 1, self.capacity, length, source, cluster)

    def _put(self, b, residual, length, source, cluster):
        self.sources[b] |= source
        self.clusters[b] |= cluster
        left = residual - length
        if left:
            self.by_residual[left].append(b)
            self.used |= 1 << left
        return b, self.capacity - residual


def pack(rows: list[tuple], capacity: int) -> list[tuple]:
    """rows: (doc_id, source, cluster, length). Returns (row, piece, bin, offset, length), whole lengths covered."""
    items = []
    for i, (_, _, _, n) in enumerate(rows):
        for piece, at in enumerate(range(0, n, capacity)):
            items.append((min(capacity, n - at), i, piece))
    items.sort(key=lambda x: (-x[0], rows[x[1]][0] is None, rows[x[1]][0] if rows[x[1]][0] is not None else 0, x[1], x[2]))
    source_bits: dict = {}
    cluster_bits: dict = {}
    seen = Counter(rows[i][2] for _, i, _ in items if rows[i][2] is not None)  # a cluster seen once needs no bit
    bins, out = Bins(capacity), []
    for length, i, piece in items:
        _, source, cluster, _ = rows[i]
        s = 0 if source is None else 1 << source_bits.setdefault(source, len(source_bits))
        c = 0 if seen.get(cluster, 0) < 2 else 1 << cluster_bits.setdefault(cluster, len(cluster_bits))
        b, at = bins.place(length, s, c)
        out.append((i, piece, b, at, length))
    return out


def _lengths(batches):
    import xxhash

    for batch in batches:
        texts = texts_of(batch.column(2))
        words = [t.split() for t in texts]
        n = pa.array([len(w) + 1 for w in words], pa.int64())
        cluster = np.array([xxhash.xxh64_intdigest(b" ".join(w).lower()) if w else 0 for w in words], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, pa.array(cluster, mask=np.array([not w for w in words], bool))], names=["doc_id", "source", "length", "cluster"])


def measured(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, length, cluster): words and one end; texts of the same lower-cased words share a cluster.

    groups: (doc_id, component_id) of near copies, as jaccard.linked() and simhash.alike() give them, which then are the
    clusters of the documents that they name. Texts without words have none.
    """
    ids = docs.select("doc_id", "source", "text")
    kind, source = (ids.dtypes[i][1] for i in (0, 1))
    items = ids.mapInArrow(shipped(__name__, "_lengths"), f"doc_id {kind}, source {source}, length long, cluster long")
    if groups is None:
        return items
    known = groups.where("doc_id is not null").groupBy("doc_id").agg(F.xxhash64(F.min("component_id")).alias("_own"))
    near = F.when(F.col("cluster").isNotNull(), F.coalesce("_own", "cluster")).alias("cluster")
    return items.join(known, "doc_id", "left").select("doc_id", "source", "length", near)


def _packed(batches, capacity):
    """Rows sorted by shard; one shard is held at a time."""
    shard, rows = None, []

    def done():
        placed = pack(rows, capacity)
        cols = list(zip(*placed)) or [()] * 5
        ids = [rows[i][0] for i in cols[0]]
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(cols[k], pa.int64()) for k in (1,)), pa.array([shard] * len(ids), pa.int64()), *(pa.array(cols[k], pa.int64()) for k in (2, 3, 4))], names=["doc_id", "piece", "shard", "bin", "start", "length"])

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        data = batch.to_pydict()
        for s, *row in zip(data["shard"], data["doc_id"], data["source"], data["cluster"], data["length"]):
            if s != shard:
                if rows:
                    yield done()
                shard, rows = s, []
            rows.append(tuple(row))
    if rows:
        yield done()


def best_fit(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, shard, bin, start, length) for items of (doc_id, source, length, cluster).

    A document longer than capacity is cut to pieces of capacity and a rest; every token has a place. A bin holds at
    most one piece of a source and at most one of a cluster; a null source or cluster never conflicts, and neither
    does a null length, which counts as 0 and has no place. Equal lengths go by doc_id, nulls last. No items, no rows.
    """
    kind = dict(items.dtypes)["doc_id"]
    items = items.select("doc_id", F.col("source").cast("string").alias("source"), "cluster", F.coalesce("length", F.lit(0)).cast("long").alias("length"))
    items = cut(items.groupBy("doc_id", "source", "cluster", "length").agg(F.count("*").alias("copies")), "pack-items")
    n = items.agg(F.sum(F.col("copies") * F.greatest(F.lit(1), F.ceil(F.col("length") / capacity)))).first()[0] or 0
    shards = max(1, -(-int(n) // shard))
    copy = items.select("doc_id", "source", "cluster", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    placed = F.pmod(F.xxhash64("doc_id", "cluster", "length", F.floor(F.col("copy") / SPREAD)), F.lit(shards)).alias("shard")
    dealt = copy.select("*", placed).repartition("shard").sortWithinPartitions("shard", "doc_id", "length", "cluster", "source", "copy")
    return dealt.mapInArrow(shipped(__name__, "_packed", capacity), f"doc_id {kind}, piece long, shard long, bin long, start long, length long")


def op5_pack(spark, sf_dir) -> DataFrame:
    """Query: all documents into sequences of 2048 words, no source and no cluster of copies twice in one."""
    return best_fit(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")))
