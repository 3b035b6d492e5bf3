"""Conformal p-values, exact intervals, step-down correction, permutation tests and cluster bootstraps."""

from __future__ import annotations

import hashlib
import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ragweave.functions.ship import shipped
from ragweave.functions.text import finite
from ragweave.sources.store import held


def cumulated(points: DataFrame, value: str, count: str) -> DataFrame:
    """points, one row for each value, with the counts below it (lo), up to it (hi) and in all (n).

    The running sum runs over ranges of values, each with the total of the ranges below it, so no task sees all values.
    """
    edges = points.approxQuantile(value, [i / 64 for i in range(1, 64)], 0.001) or []
    bucket = F.lit(0)
    for e in sorted(set(edges)):
        bucket = bucket + (F.col(value) >= e).cast("int")
    points = points.withColumn("_b", bucket)
    totals = points.groupBy("_b").agg(F.sum(count).alias("t"))  # 64 rows at most
    below = F.coalesce(F.sum("t").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("_b", below.alias("_below"), F.sum("t").over(W.partitionBy()).alias("n"))
    hi = F.sum(count).over(W.partitionBy("_b").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("_below")
    return points.join(F.broadcast(totals), "_b").withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col(count)).drop("_b", "_below")


def quantile(rows: DataFrame, value: str, q: float, name: str) -> DataFrame:
    """One row with the exact quantile, interpolated linearly; null without values. Values are counted first."""
    points = cumulated(rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c")), "v", "c")
    at = (F.col("n") - 1) * F.lit(q)
    left = F.max(F.when((F.col("lo") <= F.floor(at)) & (F.floor(at) < F.col("hi")), F.col("v")))
    right = F.max(F.when((F.col("lo") <= F.ceil(at)) & (F.ceil(at) < F.col("hi")), F.col("v")))
    return points.agg(left.alias("l"), right.alias("r"), F.max(at - F.floor(at)).alias("f")).select((F.col("l") + F.col("f") * (F.col("r") - F.col("l"))).alias(name))


def conformal_pvalues(scores: DataFrame) -> DataFrame:
    """Test rows of (id, score, is_cal) with p = (1 + calibration scores >= score) / (n + 1); a score that is not finite is an error."""
    scores = scores.withColumn("score", finite(F.col("score"), "score"))
    points = scores.groupBy("score").agg(F.sum(F.col("is_cal").cast("long")).alias("c"))
    ranked = cumulated(points, "score", "c").select("score", (F.col("n") - F.col("lo")).alias("ge"), "n")
    tested = scores.where("not is_cal").join(ranked, "score")
    return tested.withColumn("p", (1 + F.col("ge")) / (F.col("n") + 1).cast("double")).drop("ge", "n")


def flagged(p: Column, alpha: float) -> Column:
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    return p <= alpha


def holm(tests: DataFrame, name: str = "name", p: str = "p") -> DataFrame:
    """tests with p_adj: step-down correction over the tests of one family, whatever their number.

    Equal p have one p_adj, that of the first of them, so ranks are counted per distinct p. The running count and the
    running maximum run over ranges of p, each with what the ranges below it hold, so no single task sees all tests.
    A null p is no test: it is not counted and its p_adj is null. A p that is no probability is an error.
    """
    sane = F.col(p).isNull() | (F.col(p) >= 0) & (F.col(p) <= 1)  # NaN is above 1
    tests = tests.withColumn(p, F.when(sane, F.col(p)).otherwise(F.raise_error(F.lit("p is not finite or not a probability")).cast("double")))
    points = tests.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_c"))
    edges = points.approxQuantile("_p", [i / 64 for i in range(1, 64)], 0.001) or []
    bucket = F.lit(0)
    for e in sorted(set(edges)):
        bucket = bucket + (F.col("_p") >= e).cast("int")
    points = points.withColumn("_b", bucket)
    below = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = points.groupBy("_b").agg(F.sum("_c").alias("t"))  # 64 rows at most
    totals = totals.select("_b", F.coalesce(F.sum("t").over(below), F.lit(0)).alias("_below"), F.sum("t").over(W.partitionBy()).alias("_m"))
    own = W.partitionBy("_b").orderBy("_p")
    before = F.col("_below") + F.sum("_c").over(own) - F.col("_c")
    steps = points.join(F.broadcast(totals), "_b").withColumn("_s", F.least(F.lit(1.0), F.col("_p") * (F.col("_m") - before)))
    tops = steps.groupBy("_b").agg(F.max("_s").alias("t")).select("_b", F.max("t").over(below).alias("_top"))  # 64 rows at most
    adjusted = steps.join(F.broadcast(tops), "_b").select("_p", F.greatest("_top", F.max("_s").over(own)).alias("p_adj"))
    return tests.join(adjusted, F.col(p) == F.col("_p"), "left").select(*tests.columns, "p_adj")


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def clopper_pearson_interval(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Exact binomial interval: quantiles of beta laws, by bisection."""
    if n <= 0 or not 0 <= k <= n or not 0 < alpha < 1:
        raise ValueError("need 0 <= k <= n, n > 0 and 0 < alpha < 1")

    def root(a, b, share):
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if beta_share(a, b, mid) < share else (lo, mid)
        return (lo + hi) / 2

    return 0.0 if k == 0 else root(k, n - k + 1, alpha / 2), 1.0 if k == n else root(k + 1, n - k, 1 - alpha / 2)


def _intervals(groups: tuple[pd.Series, pd.Series], alpha: float) -> pd.DataFrame:
    return pd.DataFrame([clopper_pearson_interval(int(a), int(b), alpha) for a, b in zip(*groups)], columns=["low", "high"])


def with_interval(groups: DataFrame, k: str = "k", n: str = "n", alpha: float = 0.05) -> DataFrame:
    """Groups with ci_low and ci_high; one Arrow batch of groups at a time."""
    intervals = shipped(__name__, "_intervals", alpha)

    @F.pandas_udf("low double, high double")
    def interval(ks: pd.Series, ns: pd.Series) -> pd.DataFrame:
        return intervals((ks, ns))

    return groups.withColumn("_ci", interval(F.col(k), F.col(n))).withColumn("ci_low", F.col("_ci.low")).withColumn("ci_high", F.col("_ci.high")).drop("_ci")


#: Signs that are drawn at a time.
SIGNS = 1 << 22


def _streamed(seed: int, start: int, stop: int, n: int):
    """Blocks of draws start to stop, each a matrix of n signs a draw, true for plus.

    They are those of rng.choice([-1.0, 1.0], (draws, n)): such a sign is the top bit of each half of the generator's
    outputs, the lower half first. So one that skips to its first sign draws what a single stream would: start times n
    must be even.
    """
    raw = np.random.default_rng(seed).bit_generator
    raw.advance(start * n // 2)
    rows = max(2, min(2048, SIGNS // n) // 2 * 2)
    for at in range(start, stop, rows):
        signs = np.empty(min(rows, stop - at) * n, bool)
        for x in range(0, len(signs), SIGNS):
            some = signs[x : x + SIGNS]
            some[:] = (raw.random_raw(-(-len(some) // 2)).astype("<u8", copy=False).view("<i4") < 0)[: len(some)]
        yield signs.reshape(-1, n)


def _hits(values: np.ndarray, start: int, stop: int, seed: int, statistic) -> int:
    """How many of the permutations start to stop reach the observed statistic.

    A median reaches it if more than half of the values do; only a draw in which just half of them do needs its median.
    """
    hits, observed = 0, statistic(values)
    up, down = values >= observed, -values >= observed
    gain, loss = up & ~down, down & ~up
    for signs in _streamed(seed, start, stop, len(values)):
        if statistic is np.median:
            twice = 2 * (int(down.sum()) + np.count_nonzero(signs & gain, axis=1) - np.count_nonzero(signs & loss, axis=1))
            even = signs[twice == len(values)]
            hits += int((twice > len(values)).sum()) + sum(bool(np.median(np.where(x, values, -values)) >= observed) for x in even)
        else:
            hits += sum(bool(statistic(np.where(x, values, -values)) >= observed) for x in signs)
    return hits


#: Values on either side of a place that a draw's middle is looked for among; all of them have the wrong sign once in 2**NEAR.
NEAR = 128


def _first(places: range, plus: bool, signs: np.ndarray, whole: bool) -> int | None:
    for i in places:
        if signs[i] == plus:
            return i
    if not whole:
        raise ValueError(f"{NEAR} equal signs beside a median")
    return None


def _placed_hits(n: int, observed: float, least: int, most: int, near: dict[int, float], start: int, stop: int, seed: int) -> int:
    """_hits() of the median of n sorted values, without them.

    Values from place `least` on reach the observed median, and so does what stands before place `most` with a minus.
    near: the values by their place, up to NEAR places from both.
    """
    hits = 0
    for signs in _streamed(seed, start, stop, n):
        twice = 2 * (np.count_nonzero(signs[:, least:], axis=1) + most - np.count_nonzero(signs[:, :most], axis=1))
        hits += int((twice > n).sum())
        for x in signs[twice == n]:  # the middle is that of the last value below the observed one and of the first above
            low, high = max(0, least - NEAR), min(n, least + NEAR)
            below = _first(range(least - 1, low - 1, -1), True, x, low == 0), _first(range(most, min(n, most + NEAR)), False, x, most + NEAR >= n)
            above = _first(range(least, high), True, x, high == n), _first(range(most - 1, max(0, most - NEAR) - 1, -1), False, x, most <= NEAR)
            last, following = ([side * near[i] for i, side in zip(pair, (1, -1)) if i is not None] for pair in (below, above))
            hits += (max(last) + min(following)) / 2 >= observed
    return hits


def sign_flip(values: np.ndarray, permutations: int = 10000, seed: int = 0, statistic=np.median) -> float:
    """One-sided p of a paired sign-flip test. The draws are one stream, whatever is drawn at a time."""
    values = np.asarray(values, float)
    if not len(values) or not np.isfinite(values).all() or permutations <= 0:
        raise ValueError("need finite differences and a positive number of permutations")
    return (_hits(values, 0, permutations, seed, statistic) + 1) / (permutations + 1)


def _medians(values: np.ndarray, clusters, start: int, stop: int, seed: int) -> np.ndarray:
    """Medians of the replicates start to stop: the draws before are made as well, as each takes what it needs of the stream."""
    names = np.asarray(clusters)
    own = np.unique(names)
    members = [values[names == c] for c in own] if len(own) < 64 else np.split(values[np.argsort(names, kind="stable")], np.cumsum(np.unique(names, return_counts=True)[1])[:-1])
    rng = np.random.default_rng(seed)
    for _ in range(start):
        rng.integers(0, len(own), len(own))
    return np.array([np.median(np.concatenate([members[i] for i in rng.integers(0, len(own), len(own))])) for _ in range(start, stop)])


def cluster_bootstrap(values: np.ndarray, clusters, replicates: int = 10000, alpha: float = 0.05, seed: int = 0) -> tuple[float, float]:
    """Percentile interval of the median over clusters drawn with replacement."""
    low, high = np.quantile(_medians(np.asarray(values, float), clusters, 0, replicates, seed), [alpha / 2, 1 - alpha / 2])
    return float(low), float(high)


#: Tasks among which the draws of a hypothesis are dealt.
TASKS = 16


def _samples(df: DataFrame, by: str, value: str, cluster: str | None) -> DataFrame:
    """(by, values[, clusters]): one row for each hypothesis, in order of cluster and value; a null or infinite value is an error."""
    one = F.struct(*([F.col(cluster).cast("string").alias("c")] if cluster else []), finite(F.col(value).cast("double"), "difference").alias("v"))
    held = df.groupBy(by).agg(F.array_sort(F.collect_list(one)).alias("_s"))
    return held.select(by, F.transform("_s", lambda x: x["v"]).alias("values"), *([F.transform("_s", lambda x: x["c"]).alias("clusters")] if cluster else []))


def _dealt(samples: DataFrame, by: str, draws: int) -> DataFrame:
    """samples with each block (start, stop) of their draws, one to a task; blocks begin at even draws."""
    per = 2 * -(-draws // (2 * TASKS))
    edges = [(at, min(at + per, draws)) for at in range(0, draws, per)]
    blocks = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop")) for a, b in edges))
    return samples.withColumn("_b", F.explode(blocks)).select("*", "_b.start", "_b.stop").drop("_b").repartition(len(edges), by, "start")


def _flipped_rows(batches, seeds, statistic):
    import pyarrow as pa

    for batch in batches:
        own = batch.select([n for n in batch.schema.names if n != "values"]).to_pylist()
        hits = [_hits(np.asarray(batch.column("values")[i].values, float), r["start"], r["stop"], seeds[str(r["by"])] if isinstance(seeds, dict) else seeds, statistic) for i, r in enumerate(own)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.int64())], names=["by", "hits"])


def _placed_rows(batches, seeds):
    import pyarrow as pa

    for batch in batches:
        hits = [_placed_hits(r["n"], r["observed"], r["least"], r["most"], {x["pos"]: x["v"] for x in r["near"]}, r["start"], r["stop"], seeds[str(r["by"])] if isinstance(seeds, dict) else seeds) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.int64())], names=["by", "hits"])


def _middles(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, observed, least, most, near): of each hypothesis what _placed_hits() needs. Values are numbered by ranges; no
    group, task or row holds them all."""
    from .ledger import numbered

    placed = numbered(df.select(F.col(by).alias("by"), finite(F.col(value).cast("double"), "difference").alias("v")), "v", "pos", ["by"])
    sizes = placed.groupBy("by").agg(F.count("*").alias("n"))
    with_ = lambda facts: placed.join(F.broadcast(facts.withColumnRenamed("by", "_by")), F.col("by").eqNullSafe(F.col("_by"))).drop("_by")
    middle = with_(sizes).where((F.col("pos") == F.floor((F.col("n") - 1) / 2)) | (F.col("pos") == F.floor(F.col("n") / 2)))
    facts = middle.groupBy("by", "n").agg(F.avg("v").alias("observed"))
    counts = with_(facts).groupBy("by", "n", "observed").agg(F.count_if(F.col("v") < F.col("observed")).alias("least"), F.count_if(-F.col("v") >= F.col("observed")).alias("most"))
    counts = held(counts, "middles")
    close = lambda c: (F.col("pos") >= F.col(c) - NEAR) & (F.col("pos") < F.col(c) + NEAR)
    near = with_(counts).where(close("least") | close("most")).groupBy("by", "n", "observed", "least", "most")
    return near.agg(F.collect_list(F.struct("pos", "v")).alias("near"))  # 4 * NEAR at most


def sign_flip_by(df: DataFrame, by: str, value: str, permutations: int = 10000, seed: int | dict[str, int] = 0, statistic=np.median, cluster: str | None = None) -> DataFrame:
    """(by, p): one test per hypothesis, with the p that sign_flip() gives for its sorted differences.

    The draws of a hypothesis are dealt to TASKS tasks, each of which skips to its own part of the one stream. For medians
    of differences in their own order a task holds one draw's signs, a byte each, and no differences: places and counts
    tell which draws reach the observed one. Otherwise the differences are one sample, which every one of those tasks
    holds. statistic: a function of an array that workers can import or unpickle; seed: one, or one for each hypothesis;
    cluster: differences are ordered by it first.
    """
    if permutations <= 0:
        raise ValueError("need a positive number of permutations")
    kind = dict(df.dtypes)[by]
    if statistic is np.median and cluster is None:
        dealt = _dealt(_middles(df, by, value), "by", permutations)
        hits = dealt.select("by", "n", "observed", "least", "most", "near", "start", "stop").mapInArrow(shipped(__name__, "_placed_rows", seed), f"by {kind}, hits long")
        return hits.groupBy("by").agg(((F.sum("hits") + 1) / (permutations + 1)).alias("p")).withColumnRenamed("by", by)
    dealt = _dealt(_samples(df, by, value, cluster).withColumnRenamed(by, "by"), "by", permutations).select("by", "values", "start", "stop")
    hits = dealt.mapInArrow(shipped(__name__, "_flipped_rows", seed, statistic), f"by {kind}, hits long")
    return hits.groupBy("by").agg(((F.sum("hits") + 1) / (permutations + 1)).alias("p")).withColumnRenamed("by", by)


def _median_rows(batches, seeds):
    import pyarrow as pa

    for batch in batches:
        rows = batch.to_pylist()
        found = [_medians(np.array(r["values"], float), r["clusters"], r["start"], r["stop"], seeds[str(r["by"])] if isinstance(seeds, dict) else seeds) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["by", "medians"])


def cluster_bootstrap_by(df: DataFrame, by: str, cluster: str, value: str, replicates: int = 10000, alpha: float = 0.05, seed: int | dict[str, int] = 0) -> DataFrame:
    """(by, ci_low, ci_high): cluster_bootstrap() of each hypothesis, its replicates dealt to TASKS tasks."""
    kind = dict(df.dtypes)[by]
    dealt = _dealt(_samples(df, by, value, cluster).withColumnRenamed(by, "by"), "by", replicates).select("by", "values", "clusters", "start", "stop")
    medians = dealt.mapInArrow(shipped(__name__, "_median_rows", seed), f"by {kind}, medians array<double>").select("by", F.explode("medians").alias("m"))
    ends = [F.percentile("m", F.lit(q)).alias(n) for n, q in (("ci_low", alpha / 2), ("ci_high", 1 - alpha / 2))]  # of `replicates` medians
    return medians.groupBy("by").agg(*ends).withColumnRenamed("by", by)


def _draw(*parts) -> Column:
    """A whole number below 2**28 from the md5 of the parts, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 7), 16, 10).cast("long")


#: Draws that one md5 gives signs for: four numbers of 28 bits, 14 bytes of it.
BITS, DRAWS, SIGN_BYTES = 28, 112, 14
#: Rows whose digests a task holds at a time, and rows of a task.
ROWS, TASK_ROWS = 1 << 14, 1 << 16
#: Fixed values of md5: its state, its rotations by round, its constants by step, and the bytes of a message of one block.
STATE, TURNS = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476), ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES, ONE_BLOCK = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], 55


def _md5(words: list[np.ndarray | None], n: int) -> np.ndarray:
    """Rows of the four words of the md5 of n blocks, given by word; None for a word that is zero in all blocks."""
    a, b, c, d, f, g = (np.full(n, x, np.uint32) for x in (*STATE, 0, 0))
    for i in range(64):
        turn = i >> 4
        if turn == 0:
            f = np.bitwise_xor(np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f), d, out=f)
        elif turn == 1:
            f = np.bitwise_xor(np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f), c, out=f)
        elif turn == 2:
            f = np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
        else:
            f = np.bitwise_xor(np.bitwise_or(np.invert(d, out=f), b, out=f), c, out=f)
        a += f
        if (word := words[((1, 5, 3, 7)[turn] * i + (0, 1, 5, 0)[turn]) & 15]) is not None:
            a += word
        a += np.uint32(SINES[i])
        left = TURNS[turn][i & 3]
        np.right_shift(a, np.uint32(32 - left), out=g)
        a <<= np.uint32(left)
        a |= g
        a += b
        a, b, c, d = d, a, b, c
    return np.stack([x + np.uint32(y) for x, y in zip((a, b, c, d), STATE)], axis=1)


def _digests(ids: list[str | None], permutations: int) -> np.ndarray:
    """A row of bytes for each id, SIGN_BYTES of the md5 of `q:id` for each block q of DRAWS; a null id has a minus everywhere.

    Ids of which every `q:id` is one block of md5 are hashed together, the others one by one.
    """
    heads = [b"%d:" % q for q in range(-(-permutations // DRAWS))]
    out = np.full((len(heads), SIGN_BYTES, len(ids)), 255, np.uint8)
    given = [i if i is None else i.encode() for i in ids]
    size = np.array([-1 if i is None else len(i) for i in given], np.int64)
    fits = size <= ONE_BLOCK - max(map(len, heads), default=0)
    for i in np.flatnonzero(~fits).tolist():
        found = b"".join(hashlib.md5(h + given[i], usedforsecurity=False).digest() for h in heads)
        out[:, :, i] = np.frombuffer(found, np.uint8).reshape(-1, 16)[:, :SIGN_BYTES]
    some = np.flatnonzero(fits & (size >= 0))
    n, size, words = len(some), size[some], []
    width = max(1, int(max(size, default=0)))
    texts = np.array([given[i] for i in some.tolist()], f"S{width}").view(np.uint8).reshape(n, width)
    at = slice(None) if n == len(ids) else some
    for q, head in enumerate(heads if n else []):
        if not q or len(head) > len(heads[q - 1]):
            block = np.zeros((n, 64), np.uint8)
            block[:, len(head) : len(head) + width] = texts
            block[np.arange(n), len(head) + size] = 0x80
            words = np.ascontiguousarray(block.view("<u4").T)
            words[14] = 8 * (len(head) + size)
        front = np.frombuffer(head.ljust(64, b"\0"), "<u4")
        found = _md5([w | x if x else w if w.any() else None for w, x in zip(words, front)], n)
        out[q][:, at] = found.astype("<u4", copy=False).view(np.uint8)[:, :SIGN_BYTES].T
    return out.reshape(len(heads) * SIGN_BYTES, len(ids)).T


def _draw_bits(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte of _digests(), and its bit, that hold the sign of each draw: draw k from 0 is bit k % BITS of number k / BITS,
    and a number is seven hexadecimal digits, the first one the highest."""
    k = np.arange(permutations)
    digit = k % DRAWS // BITS * 7 + 6 - k % BITS // 4
    return k // DRAWS * SIGN_BYTES + digit // 2, k % BITS % 4 + 4 * (digit % 2 == 0)


def _weighed(batches, permutations):
    """(k, s) of a task's rows (i, w): the sum of w under the signs of each draw.

    Weights are summed by the value of each byte, which holds eight draws, and then by bit.
    """
    import pyarrow as pa

    totals = None
    for batch in batches:
        w = batch.column(1).to_numpy(zero_copy_only=False)
        for at in range(0, len(w), ROWS):
            found = np.ascontiguousarray(_digests(batch.column(0).slice(at, ROWS).to_pylist(), permutations).T)
            if totals is None:
                totals = np.zeros((len(found), 256))
            for total, column in zip(totals, found):
                total += np.bincount(column, w[at : at + ROWS], 256)
    if totals is not None:
        sides = 1.0 - 2.0 * (np.arange(256)[:, None] >> np.arange(8) & 1)
        byte, bit = _draw_bits(permutations)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, permutations + 1), pa.int64()), pa.array((totals @ sides)[byte, bit])], names=["k", "s"])


def _drawn(rows: DataFrame, permutations: int) -> DataFrame:
    """(k, s): the sum of w over rows (i, w) under the signs that draws from 1 give to the ids i."""
    tasks = max(1, -(-rows.count() // TASK_ROWS))
    dealt = rows.select(F.col("i").cast("string").alias("i"), F.col("w").cast("double").alias("w")).repartition(tasks)
    return dealt.mapInArrow(shipped(__name__, "_weighed", permutations), "k long, s double").groupBy("k").agg(F.sum("s").alias("s"))


#: Children of a range of positions; ranks are found one digit of this base after the other.
BASE = 64


def _positions(values: DataFrame, value: str) -> tuple[DataFrame, int]:
    """(value, pos) of the distinct values, in order, and the digits that positions have."""
    from .ledger import numbered

    placed = numbered(values.select(value).where(F.col(value).isNotNull()).distinct(), value, "pos")
    n = placed.count()
    levels = 1
    while BASE**levels < n:
        levels += 1
    return placed, levels


def _digit(pos: Column, level: int, levels: int) -> Column:
    return F.floor(pos / F.lit(BASE ** (levels - 1 - level))).cast("long") % BASE


def _prefix(pos: Column, level: int, levels: int) -> Column:
    return F.floor(pos / F.lit(BASE ** (levels - level))).cast("long")


def _at_rank(targets: DataFrame, counts, levels: int) -> DataFrame:
    """(k, t, pos) of targets (k, t, rank), the position that holds each rank from 0.

    counts: from (k, t, prefix) and a level to (k, t, digit, w), the weights of a draw's values in the children of the
    range that `prefix` names. Each level picks one child, so no group holds more than BASE rows, whatever the values.
    """
    found = targets.withColumn("prefix", F.lit(0).cast("long"))
    for level in range(levels):
        w = W.partitionBy("k", "t").orderBy("digit")
        upto = counts(found, level).withColumn("hi", F.sum("w").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
        both = upto.join(found, ["k", "t"]).where((F.col("rank") < F.col("hi")) & (F.col("rank") >= F.col("hi") - F.col("w")))
        found = held(both.select("k", "t", (F.col("rank") - F.col("hi") + F.col("w")).alias("rank"), (F.col("prefix") * BASE + F.col("digit")).alias("prefix")), "ranks")
    return found.select("k", "t", F.col("prefix").alias("pos"))


def _middle(totals: DataFrame) -> DataFrame:
    """(k, t, rank): the one or two middle ranks of each (k, total)."""
    ranks = F.array_distinct(F.array(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)))
    return totals.select("k", F.posexplode(ranks).alias("t", "rank"))


def _rounded(x: float, places: int) -> float:
    """As round() of a column has it: half away from zero, on the digits that the number is written with."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


def _even_hits(signed: DataFrame, tied: np.ndarray, observed: float, permutations: int, places: int, window: int = 4096) -> int:
    """How many of the draws `tied`, in which just half of the values reach the observed median, have a median that does.

    signed: (i, kept, v, at), each value with either sign and whether it reaches the observed one. The middle of a draw is
    that of the last value below and of the first above that have the draw's sign; they are looked for among `window`
    values on either side, and in more of them if a draw has none there.
    """
    byte, bit = (x[tied - 1] for x in _draw_bits(permutations))
    middle = np.zeros(len(tied))
    for above in (False, True):
        size, ahead = window, F.col("v") if above else -F.col("v")
        while True:
            rows = signed.where(F.col("at") == above).orderBy(ahead).limit(size).toArrow()  # `window` rows, nearly always
            kept, v = (rows.column(c).to_numpy() for c in ("kept", "v"))
            first = np.full(len(tied), -1)
            for at in range(0, len(kept), 512):
                open_ = np.flatnonzero(first < 0)
                if not len(open_):
                    break
                digests = _digests(rows.column("i").slice(at, 512).to_pylist(), permutations)
                fits = (digests[:, byte[open_]] >> bit[open_].astype(np.uint8) & 1 == 0) == kept[at : at + 512].astype(bool)[:, None]
                first[open_] = np.where(fits.any(axis=0), at + fits.argmax(axis=0), -1)
            if (first >= 0).all() or len(kept) < size:
                break
            size *= 16
        middle += v[first]
    return sum(_rounded(float(m) / 2, places) >= observed for m in middle)


def sign_flip_hash(df: DataFrame, id_: str, value: str, permutations: int = 10000, statistic: str = "sum") -> DataFrame:
    """(observed, p): sums or medians under signs drawn by hash; rows without a value take no part.

    One md5 gives the signs of 112 draws. A task sums weights by the bytes of the digests, eight draws at a time, and only
    one sum a draw leaves it. A sum's weights are the values. A median reaches the observed one if more than half of the
    signed values do, so its weights are 1 or -1 for those that reach it with one sign only; draws in which just half of
    them do are decided by the values beside the observed median.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(id_).alias("i"), F.col(value).cast("double").alias("v"))
    if statistic == "sum":
        observed = rows.agg(F.round(F.sum("v"), 6).alias("observed"))
        drawn = _drawn(rows.withColumnRenamed("v", "w"), permutations).withColumn("s", F.round("s", 6))
        return drawn.crossJoin(F.broadcast(observed)).groupBy("observed").agg(((F.count_if(F.col("s") >= F.col("observed")) + 1) / F.lit(permutations + 1.0)).alias("p"))  # one row beside the draws
    observed = quantile(rows, "v", 0.5, "observed").select(F.round("observed", 9).alias("observed")).first().observed
    if observed is None:
        return df.sparkSession.createDataFrame([], "observed double, p double")
    up, down = (F.round(x, 9) >= observed for x in (F.col("v"), -F.col("v")))
    sides = rows.withColumn("up", up).withColumn("down", down)
    weights = sides.where("up <> down").select("i", F.col("up").cast("int") - F.col("down").cast("int"))
    n, both = sides.agg(F.count("*"), F.sum(F.col("up").cast("int") + F.col("down").cast("int"))).first()
    sums = {r.k: r.s for r in _drawn(weights.toDF("i", "w"), permutations).collect()}  # one whole number a draw
    twice = np.array([both + sums.get(k, 0) for k in range(1, permutations + 1)])  # twice the values that reach it
    hits, tied = int((twice > n).sum()), np.flatnonzero(twice == n) + 1
    if len(tied):
        side = lambda v, kept, at: F.struct(F.lit(kept).alias("kept"), v.alias("v"), F.col(at).alias("at"))
        signed = sides.select(F.col("i").cast("string").alias("i"), F.explode(F.array(side(F.col("v"), True, "up"), side(-F.col("v"), False, "down"))).alias("s")).select("i", "s.*").where("i is not null or not kept")
        hits += _even_hits(signed, tied, observed, permutations, 9)
    return df.sparkSession.createDataFrame([(observed, (hits + 1) / (permutations + 1.0))], "observed double, p double")


def cluster_bootstrap_hash(df: DataFrame, cluster: str, value: str, replicates: int = 10000, alpha: float = 0.05) -> DataFrame:
    """(ci_low, ci_high) of the median over clusters drawn with replacement by hash.

    Rows are counted by cluster and position of the value first; a replicate weighs those counts, and its median is found by
    rank, digit by digit of the position, so that no group holds the values of a replicate. Clusters are numbered by ranges.
    """
    from .ledger import numbered

    rows = df.where(F.col(value).isNotNull()).select(F.col(cluster).alias("c"), F.col(value).cast("double").alias("v"))
    placed, levels = _positions(rows, "v")
    own = held(rows.groupBy("c", "v").agg(F.count("*").alias("n")).join(placed, "v").select("c", "pos", "n"), "weights")
    names = numbered(rows.select("c").distinct(), "c", "i")
    all_ = names.count()
    draws = names.select("i", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("k")).withColumn("i", _draw(F.col("k"), F.col("i")) % all_)
    times = held(draws.groupBy("k", "i").agg(F.count("*").alias("times")).join(names, "i").select("k", "c", "times"), "times")

    def counts(found: DataFrame, level: int) -> DataFrame:
        near = own.withColumn("prefix", _prefix(F.col("pos"), level, levels)).join(found.select("prefix").distinct(), "prefix", "left_semi")
        cells = near.groupBy("c", "prefix", _digit(F.col("pos"), level, levels).alias("digit")).agg(F.sum("n").alias("n"))
        return found.join(times, "k").join(cells, ["c", "prefix"]).groupBy("k", "t", "digit").agg(F.sum(F.col("times") * F.col("n")).alias("w"))

    totals = times.join(own.groupBy("c").agg(F.sum("n").alias("n")), "c").groupBy("k").agg(F.sum(F.col("times") * F.col("n")).alias("total"))
    medians = _at_rank(_middle(totals), counts, levels).join(placed, "pos").groupBy("k").agg(F.avg("v").alias("m"))
    return medians.agg(F.percentile("m", F.lit(alpha / 2)).alias("ci_low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("ci_high"))
