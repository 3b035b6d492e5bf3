"""Hard negatives by dual-tree search over vectors of whole numbers.

Candidates are dealt to blocks; a task holds one block, builds a tree over it and streams the anchors past, a batch with
a tree of its own at a time. A node is a ball around the mean of its rows: the inner products of an anchor node and a
candidate node lie between <c, d> - (|c| s + |d| r + r s) and the same with a plus sign (means c, d, radii r, s), so a
pair of nodes whose interval misses what its anchors still want is left out with all anchors below it. Nodes of one label
are left out by label. What remains at leaves is scored exactly, as whole numbers.

Two searches run: the best rows of an anchor's own label (its positives), then for each of them the best rows of another
label whose score lies in a band below it. A bounded sample of rows, scored against every anchor, gives each search a
first threshold that no result can be below; it decides how much is left out, never what is found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, shipped

#: SEED rows at most are sampled for first thresholds; BLOCK is bytes of candidates that a task holds, LEAST rows of the smallest block worth a task.
POSITIVES, NEGATIVES, LOW, HIGH, EVERY, SCALE = 5, 3, 50, 95, 50, 256
LEAF, GROUP, SEED, BLOCK, LEAST = 128, 64, 2048, 48 << 20, 2048
_LOWEST, _NONE = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _dtype(most: int):
    return np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64


def _exact(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Inner products of rows of whole numbers up to `most` in size: by floating point where that is exact."""
    if most * most * max(1, a.shape[1]) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Tree:
    """A binary tree over rows: first by label, then by the widest dimension, down to `leaf` rows. Node 0 is the root."""

    def __init__(self, x: np.ndarray, label: np.ndarray, ids: np.ndarray, leaf: int):
        order = np.argsort(label, kind="stable")
        self.lo, self.hi, self.left, self.right, centres, radii, one, least = [], [], [], [], [], [], [], []
        stack = [(0, len(x), -1, False)]
        while stack:
            a, b, parent, is_right = stack.pop()
            node = len(self.lo)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            rows = order[a:b]
            own = x[rows].astype(np.float64)
            centre = own.mean(0)
            gap = own - centre
            centres.append(centre)
            radii.append(np.sqrt((gap * gap).sum(1).max()))
            pure = label[order[a]] == label[order[b - 1]] if b - a < 2 or label[rows].min() == label[rows].max() else False
            one.append(pure)
            least.append(ids[rows].min())
            self.lo.append(a)
            self.hi.append(b)
            self.left.append(-1)
            self.right.append(-1)
            if b - a <= leaf:
                continue
            if not pure:
                by = label[rows]
                mid = int(np.searchsorted(by, by[(b - a) // 2]))
                mid = a + (mid or int(np.searchsorted(by, by[0], side="right")))
            else:
                wide = int(np.argmax(own.max(0) - own.min(0))) if own.shape[1] else 0
                mid = a + (b - a) // 2
                if own.shape[1]:
                    order[a:b] = rows[np.argpartition(own[:, wide], mid - a)]
            stack += [(a, mid, node, False), (mid, b, node, True)]
        self.order, self.lo, self.hi, self.left, self.right = order, np.array(self.lo), np.array(self.hi), np.array(self.left), np.array(self.right)
        self.centre, self.radius, self.one, self.least = np.array(centres), np.array(radii), np.array(one), np.array(least)
        self.norm = np.sqrt((self.centre * self.centre).sum(1))
        self.label = label[order[self.lo]]
        self.x, self.ids, self.labels = x[order], ids[order], label[order]


def _intervals(q: Tree, node: int, t: Tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds on the inner products of the rows of a node of q and of nodes of t, rounded outwards to whole numbers."""
    mid = t.centre[nodes] @ q.centre[node]
    spread = q.norm[node] * t.radius[nodes] + t.norm[nodes] * q.radius[node] + q.radius[node] * t.radius[nodes]
    slack = 1e-9 * (np.abs(mid) + spread) + 1e-6
    return np.ceil(mid - spread - slack), np.floor(mid + spread + slack)


class Search:
    """The first `keep` rows for each slot of each anchor: slots are bands lo <= score <= hi, and at least floor."""

    def __init__(self, q: Tree, lo: np.ndarray, hi: np.ndarray, floor: np.ndarray, keep: int, same: bool, most: int):
        self.q, self.keep, self.same, self.most = q, keep, same, most
        self.lo, self.hi, self.floor = (x[q.order] for x in (np.maximum(lo, floor), hi, floor))
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def run(self, t: Tree) -> None:
        self._down(0, t, np.zeros(1, np.int64))

    def _fits(self, node: int, t: Tree, nodes: np.ndarray, want_lo: float, want_hi: float) -> np.ndarray:
        if self.q.one[node]:
            equal = t.one[nodes] & (t.label[nodes] == self.q.label[node])
            nodes = nodes[equal | ~t.one[nodes]] if self.same else nodes[~equal]
        if not len(nodes):
            return nodes
        least, most = _intervals(self.q, node, t, nodes)
        return nodes[(most >= want_lo) & (least <= want_hi)]

    def _down(self, node: int, t: Tree, nodes: np.ndarray) -> None:
        a, b = self.q.lo[node], self.q.hi[node]
        live = self.lo[a:b] <= self.hi[a:b]
        if not live.any():
            return
        want_lo, want_hi = self.lo[a:b][live].min(), self.hi[a:b][live].max()
        nodes = self._fits(node, t, nodes, want_lo, want_hi)
        inner = t.left[nodes] >= 0
        if self.q.left[node] >= 0:
            nodes = np.concatenate([nodes[~inner], t.left[nodes[inner]], t.right[nodes[inner]]])
            if len(nodes):
                self._down(self.q.left[node], t, nodes)
                self._down(self.q.right[node], t, nodes)
            return
        leaves = [nodes[~inner]]
        nodes = nodes[inner]
        while len(nodes):
            nodes = self._fits(node, t, np.concatenate([t.left[nodes], t.right[nodes]]), want_lo, want_hi)
            inner = t.left[nodes] >= 0
            leaves.append(nodes[~inner])
            nodes = nodes[inner]
        self._leaf(a, b, t, np.concatenate(leaves))

    def _leaf(self, a: int, b: int, t: Tree, leaves: np.ndarray) -> None:
        """Anchors a to b against leaves, the most promising first; slots that are full raise what they want."""
        if not len(leaves):
            return
        x, label, ids = self.q.x[a:b], self.q.labels[a:b], self.q.ids[a:b]
        own = x.astype(np.float64)
        mid = own @ t.centre[leaves].T
        spread = np.sqrt((own * own).sum(1))[:, None] * t.radius[leaves][None, :]
        slack = 1e-9 * (np.abs(mid) + spread) + 1e-6
        top, bottom = np.floor(mid + spread + slack), np.ceil(mid - spread - slack)
        order = np.lexsort((t.least[leaves], -top.max(0)))
        lo, hi = self.lo[a:b].copy(), self.hi[a:b]
        last = np.full(lo.shape, _NONE)  # of full slots the greatest id at the lowest score
        slots = lo.shape[1]
        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        for leaf in order.tolist():
            node = leaves[leaf]
            up, down = top[:, leaf, None], bottom[:, leaf, None]
            open_ = (lo <= hi) & (down <= hi) & ((up > lo) | (up == lo) & (t.least[node] <= last))
            rows = np.flatnonzero(open_.any(1))
            if not len(rows):
                continue
            s, e = t.lo[node], t.hi[node]
            score = _exact(x[rows], t.x[s:e], self.most)
            other = t.ids[s:e][None, :] != ids[rows][:, None]
            alike = t.labels[s:e][None, :] == label[rows][:, None]
            score3 = score[:, None, :]
            ok = (other & (alike if self.same else ~alike))[:, None, :] & (score3 >= lo[rows][:, :, None]) & (score3 <= hi[rows][:, :, None])
            r, j, c = np.nonzero(ok)
            if not len(r):
                continue
            slot = np.concatenate([held[0], rows[r] * slots + j])
            value = np.concatenate([held[1], score[r, c]])
            name = np.concatenate([held[2], t.ids[s:e][c]])
            rank = np.lexsort((name, -value, slot))
            slot, value, name = slot[rank], value[rank], name[rank]
            begin = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
            within = np.arange(len(slot)) - np.repeat(begin, np.diff(np.r_[begin, len(slot)]))
            first = within < self.keep
            held = slot[first], value[first], name[first]
            full = np.flatnonzero(within == self.keep - 1)
            lo.ravel()[slot[full]] = value[full]
            last.ravel()[slot[full]] = name[full]
        if len(held[0]):
            self.found.append((self.q.order[a + held[0] // slots] * slots + held[0] % slots, held[1], held[2]))


def _whole(column: pa.Array, dim: int, scale: int, dtype) -> np.ndarray:
    """Rows floor(scale * x); a vector that is shorter than dim has 0 where it ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), dim), dtype)
    values = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(n) and (n == dim).all():
        out[:] = values.reshape(len(n), dim)
    elif len(n):
        row = np.repeat(np.arange(len(n)), n)
        out[row, np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out


def _vectors(batches, dim, scale, most):
    """(id, label, x): the vector as bytes of whole numbers of the least size that holds them all."""
    dtype = _dtype(most)
    for batch in batches:
        x = _whole(batch.column(2), dim, scale, dtype)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "label", "x"])


def _rows(batch, at: int, dim: int, most: int):
    """(ids, labels, x) of the columns of a batch from `at` on."""
    ids, label = (batch.column(at + i).to_numpy(zero_copy_only=False) for i in range(2))
    x = np.frombuffer(b"".join(batch.column(at + 2).to_pylist()), _dtype(most)).reshape(len(ids), dim)
    return ids, label, x


def _slots(batch, at: int, slots: int) -> list[np.ndarray]:
    return [np.array(batch.column(at + i).to_pylist(), np.int64).reshape(batch.num_rows, slots) for i in range(3)]


def _first(batches, dim, most, slots, keep, same, shared):
    """Anchors with a floor for each slot: the score of the last of its first `keep` among the sampled rows."""
    ids, label, x = shared.value
    for batch in batches:
        own = _rows(batch, 1, dim, most)
        lo, hi, floor = _slots(batch, 4, slots)
        if len(ids):
            for a in range(0, len(own[0]), GROUP):
                score = _exact(own[2][a : a + GROUP], x, most)
                alike = own[1][a : a + GROUP, None] == label[None, :]
                ok = (alike if same else ~alike) & (own[0][a : a + GROUP, None] != ids[None, :])
                for j in range(slots):
                    fits = ok & (score >= lo[a : a + GROUP, j, None]) & (score <= hi[a : a + GROUP, j, None])
                    if len(ids) >= keep:
                        floor[a : a + GROUP, j] = np.partition(np.where(fits, score, _LOWEST), len(ids) - keep, axis=1)[:, len(ids) - keep]
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(list(floor), pa.list_(pa.int64()))], names=["aid", "id", "label", "x", "lo", "hi", "floor"])


def _visit(batches, blocks):
    """A copy of each anchor for every block."""
    for batch in batches:
        n = batch.num_rows
        for b in range(blocks):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, b)), pa.array(np.ones(n, np.int8)), *batch.columns], names=["block", "role", "aid", "id", "label", "x", "lo", "hi", "floor"])


def _searched(batches, dim, most, slots, keep, same):
    """Rows sorted by block and role, candidates before anchors: (aid, slot, id, score) of the block's first ones."""
    block, parts, tree = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, role = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        edges = np.r_[0, np.flatnonzero((key[1:] != key[:-1]) | (role[1:] != role[:-1])) + 1, len(key)].tolist()
        for a, b in zip(edges, edges[1:]):
            some = batch.slice(a, b - a)
            if key[a] != block:
                block, parts, tree = key[a], [], None
            if role[a] == 0:
                parts.append(_rows(some, 3, dim, most))
                continue
            if tree is None:
                if not parts:
                    continue
                ids, label, x = (np.concatenate([p[i] for p in parts]) for i in range(3))
                parts = []
                tree = Tree(x, label, ids, LEAF)
            ids, label, x = _rows(some, 3, dim, most)
            search = Search(Tree(x, label, ids, GROUP), *_slots(some, 6, slots), keep, same, most)
            search.run(tree)
            aid = some.column(2).to_numpy(zero_copy_only=False)
            if search.found:
                at, value, name = (np.concatenate([f[i] for f in search.found]) for i in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(aid[at // slots]), pa.array(at % slots, pa.int32()), pa.array(name), pa.array(value)], names=["aid", "slot", "found", "score"])


def best(candidates: DataFrame, anchors: DataFrame, dim: int, most: int, slots: int, keep: int, same: bool, blocks: int, seed: tuple) -> DataFrame:
    """(aid, slot, found, score, place): the first `keep` candidates of each slot of each anchor, place from 1.

    candidates: (id, label, x); anchors: (aid, id, label, x, lo, hi, floor) with an entry for each slot. Rows with the
    anchor's id never count. Ties go by id.
    """
    shared = candidates.sparkSession.sparkContext.broadcast(seed)  # SEED rows at most
    floored = anchors.mapInArrow(shipped(__name__, "_first", dim, most, slots, keep, same, shared), anchors.schema)
    visits = floored.mapInArrow(shipped(__name__, "_visit", blocks), "block long, role byte, aid long, id long, label long, x binary, lo array<long>, hi array<long>, floor array<long>")
    none = F.lit(None).cast("array<long>")
    owned = candidates.select(F.pmod(F.xxhash64("id", "x"), F.lit(blocks)).alias("block"), F.lit(0).cast("byte").alias("role"), F.lit(None).cast("long").alias("aid"), "id", "label", "x", *(none.alias(c) for c in ("lo", "hi", "floor")))
    dealt = owned.unionByName(visits).repartition(blocks, "block").sortWithinPartitions("block", "role")
    found = dealt.mapInArrow(shipped(__name__, "_searched", dim, most, slots, keep, same), "aid long, slot int, found long, score long")
    return found.withColumn("place", F.row_number().over(W.partitionBy("aid", "slot").orderBy(F.desc("score"), "found"))).where(F.col("place") <= keep)


def mined(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, sample: int = SEED, block: int = BLOCK, least: int = LEAST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), rank from 1.

    vectors: vec_id, embedding, label; anchors: which rows are anchors. A component x counts as floor(scale * x). An
    anchor's positives are the first rows of its label by inner product, its negatives for each of them the first rows
    of other labels with low * p <= 100 * n <= high * p; ties go by vec_id. Rows without a vec_id or a label, without a
    vector, or with a component that is null or not finite take no part. Rows with the anchor's vec_id are never its
    positives or negatives; rows that repeat a vec_id each take part, as anchors too. A vector shorter than the longest
    one counts as 0 where it ends. Scores beyond 64 bits are an error. Other columns are not looked at. No rows, no result.
    """
    spark = vectors.sparkSession
    fine = F.forall("embedding", lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "embedding", F.coalesce(anchors, F.lit(False)).alias("anchor"))
    size = F.aggregate("embedding", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(F.floor(v.cast("double") * scale).cast("double"))))
    n, dim, top = rows.agg(F.count("*"), F.max(F.size("embedding")), F.max(size)).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], schema)
    most = int(top) + 1
    if most * most * max(1, dim) >= 1 << 63:
        raise ValueError("components are too large for scores of 64 bits")
    rows = rows.select("id", "label", "embedding", "anchor")
    whole = shipped(__name__, "_vectors", dim, scale, most)
    candidates = cut(rows.select("id", "label", "embedding").mapInArrow(whole, "id long, label long, x binary"), "negatives-rows")
    empty = lambda v: F.array(*(F.lit(x).cast("long") for x in v))
    asked = cut(rows.where("anchor").select("id", "label", "embedding").mapInArrow(whole, "id long, label long, x binary").withColumn("aid", F.monotonically_increasing_id()), "negatives-anchors").select("aid", "id", "label", "x")
    few = candidates.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    seed = np.array([r["id"] for r in few], np.int64), np.array([r["label"] for r in few], np.int64), np.frombuffer(b"".join(r["x"] for r in few), _dtype(most)).reshape(len(few), dim)
    # as many blocks as memory asks for, and no fewer than keep the cluster busy where rows suffice
    size = np.dtype(_dtype(most)).itemsize * max(1, dim) + 24
    blocks = max(-(-n * size // block), min(2 * spark.sparkContext.defaultParallelism, n // least), 1)
    # lowest and highest are bounds that every score keeps
    bound = most * most * max(1, dim)
    first = best(candidates, asked.select("*", empty([-bound]).alias("lo"), empty([bound]).alias("hi"), empty([-bound]).alias("floor")), dim, most, 1, positives, True, blocks, seed)
    pairs = cut(first.select("aid", (F.col("place") - 1).alias("slot"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    p = F.col("positive_score")
    # whole-number division that rounds down, or up
    down, up = F.floor(p * high / F.lit(100)), F.ceil(p * low / F.lit(100))
    if bound * 100 >= 1 << 53:
        down, up = F.floor(p.cast("decimal(38,0)") * high / F.lit(100).cast("decimal(3,0)")), F.ceil(p.cast("decimal(38,0)") * low / F.lit(100).cast("decimal(3,0)"))
    limits = pairs.groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct(up.cast("long").alias("lo"), down.cast("long").alias("hi"))))).alias("m"))  # `positives` entries at most
    slot = lambda name, none: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.try_element_at("m", i)[name], F.lit(none).cast("long")))
    banded = asked.join(limits, "aid").select("aid", "id", "label", "x", slot("lo", bound).alias("lo"), slot("hi", -bound).alias("hi"), F.array_repeat(F.lit(-bound).cast("long"), positives).alias("floor"))
    second = best(candidates, banded, dim, most, positives, negatives, False, blocks, seed)
    out = second.join(pairs, ["aid", "slot"]).join(asked.select("aid", F.col("id").alias("anchor_id")), "aid")
    return out.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir) -> DataFrame:
    """Query: negatives of the rows whose vec_id is divisible by 50, labels moved where it is divisible by 7."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.withColumn("label", moved), F.col("vec_id") % EVERY == 0)


SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor({SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS alike, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % {EVERY} = 0 AND a.vec_id <> c.vec_id),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.alike AND {LOW} * p.positive_score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.positive_score
QUALIFY rank <= {NEGATIVES}
"""
