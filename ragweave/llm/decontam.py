"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, texts scanned once.

A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. The automaton
holds short items whole and longer ones in blocks of half a window, laid end to end: every window has a whole block
within its first words, so a text's windows are only looked at beside a block that it has. Those are compared by hash
and then byte by byte with the item's window. So the automaton has each item once, not once for each word of a window.
Items beyond `block_chars` characters go to further automata, each of which reads the texts once and gives only hits.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prefix_sums, ranges_hashed, shipped, texts_of, without

#: Bytes of words: digits, letters with A-Z lower-cased, and all bytes of characters beyond ASCII; others separate.
_WORD_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: Characters of items in one automaton: with its tables it takes some 60 bytes a character in a worker (see the test).
BLOCK_CHARS = 8_000_000
SCHEMA = "doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:long,end:long>>"


def normalised(text: bytes) -> bytes:
    """Words joined by single spaces; UTF-8 in and out."""
    return b" ".join(text.translate(_WORD_BYTES).split())


class Items:
    """Items to look for: the automaton, and the hash, owner and place of every window of an item that is long enough."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window, self.half, self.names, self.plain = window, (window + 1) // 2, [], []
        patterns: dict[bytes, list[int]] = {}
        blocks: set[bytes] = set()
        hashes, owners, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for name, text in items:
            plain = normalised(text.encode())
            if not plain:
                continue
            own = len(self.names)
            self.names.append(name)
            self.plain.append(plain)
            words = plain.split()
            if len(words) < window:
                patterns.setdefault(plain, []).append(own)
                continue
            blocks.update(b" ".join(words[i : i + self.half]) for i in range(0, len(words) - self.half + 1, self.half))
            start, end = word_places(plain)
            first = start[: len(words) - window + 1]
            hashes.append(ranges_hashed(prefix_sums(np.frombuffer(plain, np.uint8)), first, end[window - 1 :]))
            owners.append(np.full(len(first), own, np.int32))
            places.append(first.astype(np.int32))
        self.hashes, self.owners, self.places = map(np.concatenate, (hashes, owners, places))
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.owners, self.places = self.hashes[order], self.owners[order], self.places[order]
        self.machine = ahocorasick.Automaton() if patterns or blocks else None
        for gram in patterns.keys() | blocks:
            self.machine.add_word(f" {gram.decode('latin-1')} ", (gram.count(b" ") + 1, len(gram), gram in blocks, tuple(patterns.get(gram, ()))))
        if self.machine:
            self.machine.make_automaton()

    def scan(self, plain: bytes) -> tuple[np.ndarray, set[str]]:
        """(numbers of hit words, items) of a normalised text."""
        none = np.zeros(0, np.int64), set()
        if not plain or not self.machine:
            return none
        # `end` is the index of the closing space in " plain ", so the match starts at end - 1 - length of plain
        found = [(end - 1 - length, count, block, own) for end, (count, length, block, own) in self.machine.iter(f" {plain.decode('latin-1')} ")]
        if not found:
            return none
        start, end = word_places(plain)
        edge, items = np.zeros(len(start) + 1, np.int64), set()
        at = np.searchsorted(start, np.array([f[0] for f in found]))
        for i, (_, count, _, own) in zip(at.tolist(), found):
            if own:
                edge[i] += 1
                edge[i + count] -= 1
                items.update(own)
        beside = at[np.array([f[2] for f in found])]
        asked = np.unique((beside[:, None] - np.arange(self.half)).ravel())
        asked = asked[(asked >= 0) & (asked <= len(start) - self.window)]
        if len(asked):
            h = ranges_hashed(prefix_sums(np.frombuffer(plain, np.uint8)), start[asked], end[asked + self.window - 1])
            lo, hi = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, side="right")
            for i, a, b in zip(asked[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                gram = plain[start[i] : end[i + self.window - 1]]
                same = [o for o, p in zip(self.owners[a:b].tolist(), self.places[a:b].tolist()) if self.plain[o][p : p + len(gram)] == gram]
                if same:
                    edge[i] += 1
                    edge[i + self.window] -= 1
                    items.update(same)
        return np.flatnonzero(np.cumsum(edge[:-1]) > 0), {self.names[o] for o in items}


def word_places(plain: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word of a normalised text that is not empty."""
    spaces = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
    return np.r_[0, spaces + 1], np.r_[spaces, len(plain)]


_built: dict = {}


def _items(shared, token, window) -> Items:
    if token not in _built:
        _built.clear()
        _built[token] = Items(shared.value, window)
    return _built[token]


def original_spans(text: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Code-point ranges of the original text that runs of hit words cover."""
    raw = np.frombuffer(text.translate(_WORD_BYTES), np.uint8)
    word = raw != 32
    start = np.flatnonzero(word & ~np.r_[False, word[:-1]])
    end = np.flatnonzero(word & ~np.r_[word[1:], False]) + 1
    points = np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]
    breaks = np.flatnonzero(np.diff(hit) > 1)
    return [{"start": int(points[start[a]]), "end": int(points[end[b]])} for a, b in zip(hit[np.r_[0, breaks + 1]], hit[np.r_[breaks, len(hit) - 1]])]


def _row(text: bytes, plain: bytes, hit: np.ndarray, items: set[str]) -> tuple:
    names = sorted(items)
    return plain.count(b" ") + 1 if plain else 0, len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(hit) > 0, names, original_spans(text, hit) if len(hit) else []


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]


def _batch(ids, rows) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, _TYPES))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"])


def _scanned(batches, shared, token, window):
    built = _items(shared, token, window)
    for batch in batches:
        texts = texts_of(batch.column(1))
        yield _batch(batch.column(0), [_row(t, plain, *built.scan(plain)) for t, plain in ((t, normalised(t)) for t in texts)])


def _hits(batches, shared, token, window):
    """(row, hits, names) of texts that have any."""
    built = _items(shared, token, window)
    for batch in batches:
        found = [built.scan(normalised(t)) for t in texts_of(batch.column(1))]
        some = [i for i, (hit, _) in enumerate(found) if len(hit)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some, pa.int64())), pa.array([found[i][0].tolist() for i in some], pa.list_(pa.int64())), pa.array([sorted(found[i][1]) for i in some], pa.list_(pa.string()))], names=["_row", "hits", "names"])


def _merged(batches):
    for batch in batches:
        texts = texts_of(batch.column(1))
        rows = [_row(t, normalised(t), np.unique(np.array(hits or [], np.int64)), set(names or [])) for t, hits, names in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield _batch(batch.column(0), rows)


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans.

    items: ids as strings, sorted. spans: code-point ranges in the original text. A null text has no words. Items
    without an id or text are left out, since none could be reported; rows that repeat an item count once. An empty
    benchmark leaves every document clean; no documents, no rows.
    """
    spark = docs.sparkSession
    wanted = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").where("id is not null and text is not null").distinct()
    total = wanted.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_chars))
    schema = SCHEMA.format(kind=dict(docs.dtypes)["doc_id"])
    shared = lambda b: spark.sparkContext.broadcast([tuple(r) for r in wanted.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()])  # noqa: E731  about block_chars characters
    if blocks == 1:
        return docs.select("doc_id", "text").mapInArrow(shipped(__name__, "_scanned", shared(0), uuid.uuid4().hex, window), schema)
    rows = cut(docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()), "decontam")
    each = [cut(rows.select("_row", "text").mapInArrow(shipped(__name__, "_hits", shared(b), uuid.uuid4().hex, window), "_row long, hits array<long>, names array<string>"), "decontam-hits") for b in range(blocks)]
    hits = reduce(DataFrame.union, each).groupBy("_row").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("names")).alias("names"))
    return rows.join(hits, "_row", "left").select("doc_id", "text", "hits", "names").mapInArrow(shipped(__name__, "_merged"), schema)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without the rows in which a window of the benchmark occurs; a doc_id with one such row goes whole."""
    return without(docs, report(docs, benchmark, window).where("contaminated"))


def op2_decontaminate(spark, sf_dir) -> DataFrame:
    """Query: 10-word windows of every benchmark item against all documents."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return report(read("documents"), read("benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT DISTINCT item, size, array_to_string(ws[i:i + size - 1], ' ') AS g
  FROM (SELECT item, ws, least(10, len(ws)) AS size, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (
  SELECT r, i, size, array_to_string(ws[i:i + size - 1], ' ') AS g FROM (SELECT r, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes)),
hit AS (SELECT r, i, win.size, item FROM dw JOIN win ON dw.g = win.g AND dw.size = win.size),
covered AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT r, i, unnest(range(size)) AS k FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
