"""Quality scores: random Fourier features over document statistics, ridge by normal equations, isotonic calibration.

Statistics come from whole texts. cos(w.x + b) with Gaussian w approximates a Gaussian kernel on the standardised
statistics; each partition sums its part of the normal equations, the sums are added on executors, and the driver
solves one system of fixed size. Scores of a fold that the ridge did not see, counted in a fixed number of bins,
give a monotone map to probabilities by pooling adjacent violators.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, crc32_text, cut, shipped, slices, without

FEATURES, GAMMA, RIDGE, BINS, SEED = 256, 0.03, 1e-3, 1024, 7
#: Bytes of each class that is counted.
CLASSES = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": bytes(range(48, 58)),
    "space": b" \t\x0b\x0c\r",
    "line": b"\n",
    "stop": b".?",
    "comma": b",;:",
    "shout": b"!",
    "symbol": b"#*$%&<>",
    "pipe": b"|",
    "other": b"@_/\\=+~^`'\"()[]{}-",
    "tail": bytes(range(128, 192)),
}
NAMES = ["log_chars", "log_words", "word_length", "words_per_line", "distinct_words", "distinct_lines", "short_words", "long_words", *CLASSES]


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text of the buffer; an empty text has zeros."""
    n, out = len(offsets) - 1, np.zeros((len(offsets) - 1, len(NAMES)))
    size = np.diff(offsets)
    view = raw.tobytes()
    for i, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        words = view[s:e].split()
        if not words:
            continue
        lines = [x for x in view[s:e].split(b"\n") if x]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out[i, :8] = np.log1p(e - s), np.log1p(len(words)), lengths.mean(), np.log1p(len(words) / len(lines)), len(set(words)) / len(words), len(set(lines)) / len(lines), (lengths <= 3).mean(), (lengths >= 15).mean()
    for k, members in enumerate(CLASSES.values(), 8):
        table = np.zeros(256, np.uint8)
        table[list(members)] = 1
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(table[raw], out=total[1:])
        out[:, k] = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1)
    out[:, 8:] = np.sqrt(out[:, 8:])
    return out


def _measured(batches):
    for batch in batches:
        raw, offsets = buffer_of(batch.column(1))
        rows = [statistics(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets, 4 << 20)]
        x = np.concatenate(rows) if rows else np.zeros((0, len(NAMES)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each whole text; a null text is empty."""
    return docs.select("doc_id", "text").mapInArrow(shipped(__name__, "_measured"), f"doc_id {dict(docs.dtypes)['doc_id']}, x array<double>")


def features(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, count: int = FEATURES, gamma: float = GAMMA) -> np.ndarray:
    """Random Fourier features of exp(-gamma * |a - b|**2), with a constant column."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(0, np.sqrt(2 * gamma), (x.shape[1], count))
    b = rng.uniform(0, 2 * np.pi, count)
    z = np.clip((x - mean) / scale, -8, 8)
    return np.concatenate([np.sqrt(2 / count) * np.cos(z @ w + b), np.ones((len(x), 1))], axis=1)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, len(NAMES)))


def _summed(batches, mean, scale):
    total = np.zeros((FEATURES + 1, FEATURES + 2))
    for batch in batches:
        z = features(_rows(batch.column(0)), mean, scale)
        y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
        total += z.T @ np.concatenate([z, y[:, None]], axis=1)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])


def _added(batches):
    total = np.zeros((FEATURES + 1, FEATURES + 2))
    for batch in batches:
        for blob in batch.column(0):
            total += np.frombuffer(blob.as_py()).reshape(total.shape)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])


def _predicted(batches, mean, scale, beta, knots):
    for batch in batches:
        raw = features(_rows(batch.column(1)), mean, scale) @ beta
        score = raw if knots is None else calibrated(raw, *knots)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), *(batch.column(i) for i in range(2, batch.num_columns))], names=["doc_id", "score", *batch.schema.names[2:]])


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted non-decreasing least-squares fit by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for value, w in zip(y.tolist(), weight.tolist()):
        blocks.append([value, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, u, n = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[2] = (b[0] * b[1] + v * u) / (b[1] + u), b[1] + u, b[2] + n
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def calibrated(raw: np.ndarray, x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probabilities between knots; a hundredth keeps the raw order among equal ones."""
    return np.clip(0.99 * np.interp(raw, x, p) + 0.01 * np.clip(raw, 0, 1), 0, 1)


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, calibrate: int = 1, cutoff: float = 0.3) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Labels with a quality other than 0 or 1 are left out, as are those of fold `held`; fold `calibrate` fits only
    the map to probabilities. Without a usable label of each kind the score is 0.5. Empty and null texts have zero
    statistics and a score like any other. Rows that repeat a doc_id or a label count each.
    """
    table = cut(measured(docs).withColumn("fold", F.pmod(F.coalesce(crc32_text(F.col("doc_id")), F.lit(0)), F.lit(folds)).cast("int")), "quality-x")
    marks = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("y"))
    known = cut(table.where(F.col("fold") != held).join(marks, F.col("doc_id") == F.col("_id")).select("doc_id", "x", "y", "fold"), "quality-known")
    stats = known.select(*(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(NAMES))), *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(len(NAMES))), F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    kept = lambda df: df.select("doc_id", (F.col("fold") == held).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
    if stats["lo"] is None or stats["lo"] == stats["hi"]:
        return kept(table.withColumn("score", F.lit(0.5)))
    mean = np.array([stats[f"m{i}"] for i in range(len(NAMES))])
    scale = np.array([stats[f"s{i}"] for i in range(len(NAMES))])
    scale[scale < 1e-9] = 1.0
    fit = known.where(F.col("fold") != calibrate).select("x", "y").mapInArrow(shipped(__name__, "_summed", mean, scale), "sums binary")
    sums = sum(np.frombuffer(bytes(r[0])).reshape(FEATURES + 1, FEATURES + 2) for r in fit.repartition(8).mapInArrow(shipped(__name__, "_added"), "sums binary").collect())
    gram, right = sums[:, :-1], sums[:, -1]
    beta = np.linalg.solve(gram + RIDGE * max(1.0, gram[-1, -1]) / FEATURES * np.eye(len(gram)), right)
    kind = dict(table.dtypes)["doc_id"]
    binned = known.where(F.col("fold") == calibrate).select("doc_id", "x", "y").mapInArrow(shipped(__name__, "_predicted", mean, scale, beta, None), f"doc_id {kind}, score double, y double")
    seen = binned.groupBy(F.floor((F.greatest(F.lit(-0.5), F.least(F.lit(1.5), "score")) + 0.5) * (BINS / 2)).alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("ones")).orderBy("bin").collect()
    if seen:
        n, ones = np.array([r["n"] for r in seen], float), np.array([r["ones"] for r in seen], float)
        knots = (np.array([(r["bin"] + 0.5) * 2 / BINS - 0.5 for r in seen]), isotonic(ones / n, n))
    else:
        knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    out = table.select("doc_id", "x", "fold").mapInArrow(shipped(__name__, "_predicted", mean, scale, beta, knots), f"doc_id {kind}, score double, fold int")
    return kept(out)


def keep_good(docs: DataFrame, labels: DataFrame, cutoff: float = 0.3) -> DataFrame:
    """docs without those whose score is below cutoff; a doc_id of which one row is below goes whole."""
    return without(docs, scored(docs, labels, cutoff=cutoff).where("predicted = 0"))


def op7_quality(spark, sf_dir) -> DataFrame:
    """Query: labels.quality, learned outside fold 0 of crc32(doc_id) mod 5, for all documents."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return scored(read("documents"), read("labels"))
