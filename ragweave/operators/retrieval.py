"""Exact vector search, two-stage ranking, frozen thresholds and margins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ragweave.functions.ship import shipped
from ragweave.functions.text import finite


def _ranked(df: DataFrame, by: str, score: str, chunk: str, rank: str) -> DataFrame:
    return df.withColumn(rank, F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), chunk)))


class TopK:
    """The k best vectors of each query, from blocks of vectors of any id; memory is k ids a query and one block.

    Vectors come by rising code; ids and the rest of what was admitted are kept by code, and codes that no query holds any
    more are dropped. Equal scores (to 12 digits) go by id, in the order of its type.
    """

    #: Scores of a block at most, and vectors of a block at least.
    SCORES, BLOCK = 1 << 20, 256

    def __init__(self, matrix: np.ndarray, k: int):
        self.matrix, self.k, self.ids = matrix, k, None
        self.query, self.code, self.score = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        self.least = np.full(len(matrix), -np.inf)

    def add(self, ids: pa.Array, x: np.ndarray) -> None:
        block = max(self.BLOCK, self.SCORES // max(1, len(self.matrix)))
        for at in range(0, len(x), block):
            self._block(ids.slice(at, block), x[at : at + block])
        if self.ids is not None:
            self._trim()

    def _block(self, ids: pa.Array, x: np.ndarray) -> None:
        score = self.matrix @ x.T
        # what the best so far can not push out, by its bound less what rounding moves; ties stay for the ids to decide
        least = self.least
        fresh = np.flatnonzero(np.isneginf(least))
        if len(fresh) and score.shape[1] > self.k:  # a query without a bound has one from this block
            least = least.copy()
            least[fresh] = np.partition(np.round(score[fresh], 12), score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k]
        q, c = np.nonzero(score >= (least - 1e-12 - 1e-14 * np.abs(np.where(np.isneginf(least), 0, least)))[:, None])
        near = np.round(score[q, c], 12) >= least[q]
        q, c = q[near], c[near]
        if not len(q):
            return
        held = 0 if self.ids is None else len(self.ids)
        own, code = np.unique(c, return_inverse=True)
        some = ids.take(pa.array(own))
        self.ids = some if self.ids is None else pa.concat_arrays([self.ids, some])
        self.query, self.code, self.score = np.r_[self.query, q], np.r_[self.code, held + code], np.r_[self.score, score[q, c]]
        if len(fresh) or len(self.query) > 2 * self.k * len(self.matrix):  # sorted when as many have come as are kept
            self._trim()

    def _trim(self) -> None:
        place = np.empty(len(self.ids), np.int64)
        place[pc.array_sort_indices(self.ids, null_placement="at_start").to_numpy()] = np.arange(len(self.ids))
        key = np.round(self.score, 12)
        order = np.lexsort((place[self.code], -key, self.query))
        query = self.query[order]
        begin = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        within = np.arange(len(query)) - np.repeat(begin, np.diff(np.r_[begin, len(query)]))
        last = order[within == self.k - 1]
        self.least[self.query[last]] = key[last]
        kept = order[within < self.k]
        self.query, self.score = self.query[kept], self.score[kept]
        own, self.code = np.unique(self.code[kept], return_inverse=True)
        self.ids = self.ids.take(pa.array(own))

    def rows(self, queries: pa.Array) -> pa.RecordBatch | None:
        if self.ids is None:
            return None
        return pa.RecordBatch.from_arrays([queries.take(pa.array(self.query)), self.ids.take(pa.array(self.code)), pa.array(self.score)], names=["query_id", "chunk_id", "score"])


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _scanned(batches, shared, k):
    """Vectors against one block of queries that every task holds."""
    ids, x = shared.value
    best = TopK(x, k)
    for batch in batches:
        if batch.num_rows:
            best.add(batch.column(0), _matrix(batch.column(1)))
    if (rows := best.rows(ids)) is not None:
        yield rows


def _visited(batches, k, block):
    """Rows sorted by part and role: the vectors of a part are held, queries come to them `block` at a time."""
    part, held = None, []

    for batch in batches:
        keys, roles = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        edges = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]) | (roles[1:] != roles[:-1])) + 1, len(keys)].tolist() if len(keys) else [0]
        for a, b in zip(edges, edges[1:]):
            some = batch.slice(a, b - a)
            if keys[a] != part:
                part, held = keys[a], []
            if roles[a] == 0:
                held.append((some.column(3), _matrix(some.column(4))))
                continue
            for at in range(0, b - a, block):
                own = some.slice(at, block)
                best = TopK(_matrix(own.column(4)), k)
                for ids, x in held:
                    best.add(ids, x)
                if (rows := best.rows(own.column(2))) is not None:
                    yield rows


#: Queries that meet a part of the vectors in one task.
GROUP = 16384


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096, part_bytes: int = 16 << 20, group: int = GROUP) -> DataFrame:
    """(query_id, chunk_id, score, rank): exact inner products, ties by chunk_id.

    vectors: (chunk_id, vec), queries: (query_id, vec), ids of any type that can be ordered. Rows without a vector, or
    with a component that is no number, take no part. Up to `block` queries are sent to every task, and the vectors are
    scanned where they lie. More of them visit parts of the vectors of about `part_bytes`, about `group` queries and one
    part to a task, so that no task's work grows with the tables: their number does, with the pairs. A vector is moved
    once for each group, a query once for each part. A task keeps k rows of each query that it is at; a window then ranks
    k rows per query and part.
    """
    kinds = {"query_id": dict(queries.dtypes)["query_id"], "chunk_id": dict(vectors.dtypes)["chunk_id"]}
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double"
    spark = vectors.sparkSession
    whole = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v))
    vectors = vectors.select("chunk_id", F.col("vec").cast("array<double>").alias("vec")).where(whole)
    queries = queries.select("query_id", F.col("vec").cast("array<double>").alias("vec")).where(whole)
    few = queries.limit(block + 1).toArrow()  # block + 1 rows at most
    if few.num_rows <= block:
        ids = few.column("query_id").combine_chunks()
        found = vectors.mapInArrow(shipped(__name__, "_scanned", spark.sparkContext.broadcast((ids, _matrix(few.column("vec")))), k), schema) if len(ids) else spark.createDataFrame([], schema)
    else:
        size = vectors.agg(F.sum(8 * F.size("vec") + 32)).first()[0] or 0
        parts = max(1, -(-size // part_bytes))
        groups = max(1, -(-queries.count() // group))
        none = lambda name: F.lit(None).cast(kinds[name]).alias(name)
        of = lambda id_, n: F.pmod(F.xxhash64(id_), F.lit(n))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        tile = (F.col("_p") * groups + F.col("_g")).cast("int").alias("tile")
        held = vectors.select("*", of("chunk_id", parts).alias("_p"), each(groups).alias("_g")).select(tile, F.lit(0).cast("byte").alias("role"), none("query_id"), "chunk_id", "vec")
        visits = queries.select("*", each(parts).alias("_p"), of("query_id", groups).alias("_g")).select(tile, F.lit(1).cast("byte").alias("role"), "query_id", none("chunk_id"), "vec")
        dealt = held.unionByName(visits).repartitionById(parts * groups, "tile").sortWithinPartitions("tile", "role")
        found = dealt.mapInArrow(shipped(__name__, "_visited", k, min(block, 1024)), schema)
    return _ranked(found.withColumn("_s", F.round("score", 12)), "query_id", "_s", "chunk_id", "rank").where(F.col("rank") <= k).drop("_s")


def pooled(clean: DataFrame, injected: DataFrame, b: int) -> DataFrame:
    """The b best of clean and injected candidates of each query, with dense_rank from 1."""
    pool = clean.withColumn("injected", F.lit(False)).unionByName(injected.withColumn("injected", F.lit(True)))
    return _ranked(pool, "query_id", "dense_score", "chunk_id", "dense_rank").where(F.col("dense_rank") <= b)


def reranked(pool: DataFrame) -> DataFrame:
    return _ranked(pool, "query_id", "rerank_score", "chunk_id", "rerank_rank")


def context(pool: DataFrame, k: int) -> DataFrame:
    """The k first by rerank_rank, with their position from 0."""
    return pool.where(F.col("rerank_rank") <= k).withColumn("position", F.col("rerank_rank") - 1)


def _checked(pool: DataFrame, b: int, k: int, eps: float) -> DataFrame:
    if b < 1 or k < 1 or not eps > 0:
        raise ValueError("b and k must be 1 or more and eps positive")
    return pool.withColumn("dense_score", finite(F.col("dense_score").cast("double"), "dense score")).withColumn("rerank_score", finite(F.col("rerank_score").cast("double"), "rerank score"))


def _thresholds(d: str, r: str, b: int, k: int, eps: float) -> list[Column]:
    """dense_thr, rerank_thr, dense_mad, rerank_mad of a pool's scores in falling order."""

    def median(a: Column) -> Column:
        n = F.size(a)
        return (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2

    def mad(name: str) -> Column:
        centred = F.transform(F.array(F.struct(F.col(name).alias("a"), median(F.col(name)).alias("m"))), lambda s: F.sort_array(F.transform(s["a"], lambda x: F.abs(x - s["m"]))))
        return F.greatest(F.get(F.transform(centred, lambda a: median(a)), 0), F.lit(eps))

    nth = lambda name, k: F.get(F.col(name), F.least(F.lit(k), F.size(name)) - 1)
    return [nth(d, b).alias("dense_thr"), nth(r, k).alias("rerank_thr"), mad(d).alias("dense_mad"), mad(r).alias("rerank_mad")]


def frozen_thresholds(pool: DataFrame, b: int, k: int, eps: float = 1e-8) -> DataFrame:
    """(query_id, dense_thr, rerank_thr, dense_mad, rerank_mad): the b-th and k-th largest scores and the mean-free spreads.

    b and k are bounded by the pool's size. Sorting and medians run over one query's pool, of fixed size. A score that is
    not finite is an error, and so are b or k below 1.
    """
    mid = _checked(pool, b, k, eps).groupBy("query_id").agg(F.sort_array(F.collect_list("dense_score"), False).alias("d"), F.sort_array(F.collect_list("rerank_score"), False).alias("r"))
    return mid.select("query_id", *_thresholds("d", "r", b, k, eps))


def with_thresholds(pool: DataFrame, b: int, k: int, eps: float = 1e-8) -> DataFrame:
    """pool with the frozen_thresholds() of its query: a window over the pool in place of a second pass and a join."""
    own = W.partitionBy("query_id")
    held = _checked(pool, b, k, eps).withColumn("_d", F.sort_array(F.collect_list("dense_score").over(own), False)).withColumn("_r", F.sort_array(F.collect_list("rerank_score").over(own), False))
    return held.select(*pool.columns, *_thresholds("_d", "_r", b, k, eps))


def margin(dense: Column, rerank: Column) -> Column:
    """The smaller of both normalised distances over the thresholds."""
    return F.least((dense - F.col("dense_thr")) / F.col("dense_mad"), (rerank - F.col("rerank_thr")) / F.col("rerank_mad"))


def descending_boundary(scores: Column, k: int) -> Column:
    """The k-th largest of an array of scores; fewer than k are an error."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    return F.when(F.size(scores) >= k, F.get(F.sort_array(scores, False), k - 1)).otherwise(F.raise_error(F.lit("fewer scores than k")).cast("double"))


def first_donors(candidates: DataFrame, k: int = 8) -> DataFrame:
    """The k best of each query's donors of another source, long enough and each chunk once; fewer than k are an error.

    candidates: (query_id, chunk_id, score, source, own_source, fits). A query without any candidate that fits is known
    by its other candidates, so it is an error as well.
    """
    fit = F.col("fits") & (F.col("source") != F.col("own_source"))
    once = candidates.withColumn("_fit", fit).groupBy("query_id", "chunk_id").agg(F.max("_fit").alias("_fit"), F.max("score").alias("score"))
    ranked = once.withColumn("donor_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("_fit"), F.desc("score"), "chunk_id")))
    kept = ranked.where(F.col("donor_rank") <= k).withColumn("_n", F.sum(F.col("_fit").cast("int")).over(W.partitionBy("query_id")))
    sure = F.when(F.col("_n") == k, F.col("donor_rank")).otherwise(F.raise_error(F.lit(f"fewer than {k} donors")).cast("int"))
    return kept.withColumn("donor_rank", sure).select("query_id", "chunk_id", "score", "donor_rank")


def looked_up(results: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Results with the index's row of their key; a key that the index lacks is an error. Positions keep their order."""
    rows = index.withColumn("_there", F.lit(True))
    found = results.join(rows, key, "left")
    known = F.when(F.col("_there"), F.col(key)).otherwise(F.raise_error(F.lit("the index lacks a key")).cast(dict(results.dtypes)[key]))
    return found.withColumn(key, known).drop("_there")


def first_relevant(pool: DataFrame, qrels: DataFrame, query: str, source: str, rank: str) -> DataFrame:
    """Each query's best ranked row whose source qrels (query, source, score) hold with a score above 0."""
    kept = pool.join(qrels.where("score > 0").select(query, source), [query, source], "left_semi")
    best = F.min_by(F.struct(*kept.columns), F.struct(rank, source))
    return kept.groupBy(F.col(query).alias("_q")).agg(best.alias("r")).select("r.*")
