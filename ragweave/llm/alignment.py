"""Alignment of two tokenizers by bytes.

Texts are cut into units at which both tokenizers begin anew: before a space or a line feed that follows something else
than white space, and before a mark that follows an ASCII letter or digit. No token of either crosses such a place (checked
against both vocabularies when they are loaded), so a unit is encoded and aligned once for all its occurrences in a slab,
the stretch of rows whose units a task holds.

DuckDB aligns the units of an Arrow batch that are new: token intervals of both sides are tables, an overlap begins where
one of its tokens starts, so two ASOF joins find each of them once (the second with a range condition, as a token may
end before the other starts), places where both end are an equi-join, and running window sums over them number the
groups. Counts of id pairs by slab are summed in Spark, and each slab gets back the counts of the pairs it asked about.
"""

from __future__ import annotations

import functools
import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shipped, texts_of, trimmed

#: UNITS and PLACES bound a slab: distinct units, and places at which they stand. ALIGNED is bytes of new units that DuckDB is
#: given at once, ROWS the rows that are looked at together.
FOLDER, UNITS, PLACES, ALIGNED, ROWS, MEMORY = "/opt/tokenizers", 120_000, 4_000_000, 1 << 18, 256, "100MB"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Code points that stand for themselves in a byte-level vocabulary; all other bytes follow from 256 on.
PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: How a byte-level tokenizer cuts words.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary."""
    out, more = {chr(b): b for b in PLAIN}, 256
    for b in range(256):
        if b not in PLAIN:
            out[chr(more)] = b
            more += 1
    return out


class Tokenizers:
    """Both tokenizers and the bytes of their entries."""

    def __init__(self, folder: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(f"{folder}/{BYTE_BPE}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECE_BPE}")
        byte = _byte_of()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        # a piece with a line feed, or with a space after anything else, would cross the places at which units begin
        whole = [p for i, p in enumerate(pieces) if not self.b.is_byte(i) and not self.b.is_control(i)]
        how = json.loads(self.a.to_str())
        self.cuts = not any("\n" in p or "▁" in p.lstrip("▁") for p in whole) and self._begins_anew(how)
        self.marks = np.zeros(256, bool)
        follow = {b for p in whole for a, b in zip(p, p[1:]) if a.isascii() and a.isalnum()}
        self.marks[[i for i in range(0x21, 0x7F) if not chr(i).isalnum() and chr(i) not in follow]] = True
        self.fast = self._ranked(how) if self.cuts else None

    def _begins_anew(self, how: dict) -> bool:
        """Whether the byte-level side cuts its words before white space and marks, as its usual pattern does."""
        before = how["pre_tokenizer"] or {}
        return how["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", False)

    def _ranked(self, how: dict):
        """The byte-level side by ranks, where its merges stand in the order of their ids, which then rank them."""
        model = how["model"]
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        if model["type"] != "BPE" or any(model["vocab"].get(m.replace(" ", "")) != 256 + i for i, m in enumerate(merges)) or len(model["vocab"]) != 256 + len(merges):
            return None
        import tiktoken

        return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks={self.a_bytes[i]: i for i in model["vocab"].values()}, special_tokens={})

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        """Ids of a. Units of Latin letters, digits and ASCII marks, on which all versions of Unicode agree, go by ranks."""
        plain = [self.fast is not None and (t.isascii() or all(c < "\x80" or "\xc0" <= c < "\u0250" for c in t)) for t in texts]
        rest = iter([e.ids for e in self.a.encode_batch([t for t, p in zip(texts, plain) if not p], add_special_tokens=False)] if not all(plain) else [])
        return [self.fast.encode_ordinary(t) if p else next(rest) for t, p in zip(texts, plain)]

    def encode(self, units: list[bytes]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """(ids of a, ids of b, whether both give the unit's bytes) of each unit; one that is no UTF-8 fails."""
        texts = [u.decode("utf-8", "replace") for u in units]
        a = self.encode_a(texts)
        # b adds a space of its own, but to nothing; before a line feed, which no piece has, it stands alone
        b = self.b.encode([t[1:] if t[:1] == " " else "\n" + t for t in texts], num_threads=1)
        b = [[self.space] if t == " " else x if t[:1] == " " else x[2:] for x, t in zip(b, texts)]
        ok = [b"".join(map(self.a_bytes.__getitem__, x)) == u and b"".join(map(self.b_bytes.__getitem__, y)) == u for x, y, u in zip(a, b, units)]
        return a, b, ok


@functools.cache
def _loaded(folder: str) -> Tokenizers:
    return Tokenizers(folder)


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def unit_starts(text: bytes, marks: np.ndarray) -> list[int]:
    """Where units of space+text begin: 0, each space or line feed after a character that surely is no white space, and each
    of the marks after an ASCII letter or digit.

    Surely: printable ASCII, a character of two bytes beyond U+00FF, one of three beyond U+3FFF or one of four.
    """
    x = np.frombuffer(text, np.uint8)
    at = np.flatnonzero((x[1:] == 32) | (x[1:] == 10) | marks[x[1:]] & _ALNUM[x[:-1]]) + 1
    back = lambda k: x[np.maximum(at - k, 0)]
    last = back(1)
    two = (last >= 128) & (last < 192) & (back(2) >= 0xC4) & (back(2) < 0xE0) & (at >= 2)
    three = (last >= 128) & (last < 192) & (back(3) >= 0xE4) & (back(3) < 0xF0) & (at >= 3)
    four = (last >= 128) & (last < 192) & (back(4) >= 0xF0) & (at >= 4)
    return [0, *at[(last > 32) & (last < 127) | two | three | four].tolist()]


#: ta, tb: (unit, id, s, e), in bytes over all units laid end to end; each unit is covered by both.
LINKS = """
SELECT unit, a, b, count(*)::INTEGER AS n FROM (
  SELECT ta.unit, ta.id AS a, tb.id AS b FROM ta ASOF JOIN tb ON ta.s >= tb.s
  UNION ALL
  SELECT tb.unit, ta.id AS a, tb.id AS b FROM tb ASOF JOIN ta ON tb.s > ta.s WHERE tb.s < ta.e)
GROUP BY unit, a, b ORDER BY unit, a, b"""
GROUPS = """
WITH cuts AS (SELECT ta.e AS place FROM ta JOIN tb ON ta.e = tb.e),
ga AS (SELECT unit, 0 AS side, id, s, sum(CASE WHEN place IS NOT NULL OR s = 0 THEN 1 ELSE 0 END) OVER (ORDER BY s) AS g FROM ta LEFT JOIN cuts ON s = place),
gb AS (SELECT unit, 1 AS side, id, s, sum(CASE WHEN place IS NOT NULL OR s = 0 THEN 1 ELSE 0 END) OVER (ORDER BY s) AS g FROM tb LEFT JOIN cuts ON s = place)
SELECT unit, side, g::BIGINT AS g, id FROM (FROM ga UNION ALL FROM gb) ORDER BY g, side, s"""


@functools.cache
def _duck(memory: str):
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory})
    con.execute("SET preserve_insertion_order = false")
    return con


def _written(found: dict) -> tuple[np.ndarray, list[str]]:
    """(number of groups of each unit, their text) of tokens in order of group, side and place."""
    unit, side, g = (found[c].astype(np.int64) for c in ("unit", "side", "g"))
    if not len(unit):
        return np.zeros(0, np.int64), []
    # a comma within a side of a group, a bar between its sides, a semicolon between groups, a line feed between units
    kind = np.where(unit[1:] != unit[:-1], 3, np.where(g[1:] != g[:-1], 2, side[1:] != side[:-1]))
    marks = np.array([",", "|", ";", "\n"], object)[kind].tolist()
    parts = [""] * (2 * len(unit) - 1)
    parts[::2], parts[1::2] = map(str, found["id"].tolist()), marks
    return 1 + np.bincount(unit[1:], kind == 2).astype(np.int64), "".join(parts).split("\n")


def _intervals(ids: list[list[int]], size: list[int]) -> pa.Table:
    n = np.array([len(x) for x in ids], np.int64)
    flat = np.array([i for x in ids for i in x], np.int64)
    e = np.cumsum(np.array(size, np.int64)[flat]) if len(flat) else np.zeros(0, np.int64)
    s = np.r_[0, e[:-1]] if len(e) else e
    return pa.table({"unit": np.repeat(np.arange(len(ids)), n), "id": flat, "s": s, "e": e})


def aligned(tokenizers: Tokenizers, units: list[bytes], memory: str = MEMORY):
    """Of each unit (n_a, n_b, n_groups, n_links, text of its groups or None where it is not covered), and its pairs
    (unit, a, b, n) as arrays in order of unit."""
    a, b, ok = tokenizers.encode(units)
    held = [i for i, x in enumerate(ok) if x]
    con = _duck(memory)
    con.register("ta", _intervals([a[i] for i in held], [len(x) for x in tokenizers.a_bytes]))
    con.register("tb", _intervals([b[i] for i in held], [len(x) for x in tokenizers.b_bytes]))
    links = con.sql(LINKS).fetchnumpy()
    n_groups, texts = _written(con.sql(GROUPS).fetchnumpy())
    con.unregister("ta")
    con.unregister("tb")
    back = np.array(held, np.int64)
    unit = back[links["unit"].astype(np.int64)] if len(held) else np.zeros(0, np.int64)
    counts = np.zeros((4, len(units)), np.int64)
    counts[0, back] = [len(a[i]) for i in held]
    counts[1, back] = [len(b[i]) for i in held]
    text: list[str | None] = [None] * len(units)
    counts[2, back[: len(n_groups)]] = n_groups
    for u, t in zip(held, texts):
        text[u] = t
    n = links["n"].astype(np.int64)
    np.add.at(counts[3], unit, n)
    return counts, text, (unit, links["a"].astype(np.int64), links["b"].astype(np.int64), n)


class Slab:
    """The distinct units of a stretch of rows with their alignment."""

    def __init__(self, tokenizers: Tokenizers, memory: str):
        self.tokenizers, self.memory, self.number, self.text, self.places = tokenizers, memory, {}, [], 0
        self.counts, self.pairs, self.uses = [], [], []

    def numbered(self, rows: list[bytes | None]) -> list[np.ndarray | None]:
        """Units of each text as numbers; new ones are aligned. None stays, and so does a text without bytes."""
        get, fresh, size, out = self.number, [], 0, []
        for row in rows:
            if not row:
                out.append(None)
                continue
            whole = b" " + row
            at = unit_starts(whole, self.tokenizers.marks) if self.tokenizers.cuts else [0]
            own = []
            for s, e in zip(at, [*at[1:], len(whole)]):
                u = whole[s:e]
                i = get.get(u)
                if i is None:
                    i = get[u] = len(get)
                    fresh.append(u)
                    size += len(u)
                own.append(i)
            out.append(np.array(own, np.int64))
            self.places += len(own)
            if size > ALIGNED:
                self._align(fresh)
                fresh, size = [], 0
        if fresh:
            self._align(fresh)
        return out

    def _align(self, units: list[bytes]) -> None:
        base = len(self.text)
        counts, text, (unit, a, b, n) = aligned(self.tokenizers, units, self.memory)
        self.counts.append(counts)
        self.text += text
        self.pairs.append((unit + base, a << 32 | b, n))

    def done(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct pairs, how often each is linked; unit, place of the pair, n of each unit's pairs)."""
        unit, pair, n = (np.concatenate([p[i] for p in self.pairs]) for i in range(3)) if self.pairs else (np.zeros(0, np.int64),) * 3
        own, back = np.unique(pair, return_inverse=True)
        return own, np.bincount(back, n * used[unit], minlength=len(own)).astype(np.int64), unit, back, n


_ROW = ["slab", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "units", "pairs", "often", "of_unit", "of_pair", "of_n"]


def _aligned_rows(batches, folder, units, places, memory, kind):
    """Rows of documents (to groups_sha256, units) and, after them, one row of each slab (pairs, often and its units')."""
    from pyspark import TaskContext

    context = TaskContext.get()
    task, serial = (context.partitionId() << 33) if context else 0, 0
    tokenizers, slab, used = _loaded(folder), None, []

    def closed():
        n = np.bincount(np.concatenate(used), minlength=len(slab.text)) if used else np.zeros(len(slab.text), np.int64)
        own, often, unit, pair, times = slab.done(n)
        blob = lambda x, t: pa.array([x.astype(t).tobytes()], pa.binary())
        none = [pa.nulls(1, t) for t in (kind[0], *[pa.int64()] * 4, pa.string(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([task + serial]), *none, pa.array([own], pa.list_(pa.int64())), pa.array([often], pa.list_(pa.int64())), blob(unit, np.uint32), blob(pair, np.uint32), blob(times, np.uint32)], names=_ROW)

    kind = [kind]
    for batch in trimmed(batches):
        kind[0] = batch.column(0).type
        for at in range(0, batch.num_rows, ROWS):
            if slab is None:
                slab, used = Slab(tokenizers, memory), []
            some = texts_of(batch.column(1).slice(at, ROWS))
            own = slab.numbered(some)
            counts = np.concatenate(slab.counts, axis=1) if slab.counts else np.zeros((4, 0), np.int64)
            slab.counts = [counts]
            sums, digests, blobs = np.zeros((4, len(some)), np.int64), [], []
            for i, units_ in enumerate(own):
                text = [None] if units_ is None else [slab.text[u] for u in units_.tolist()]
                if None in text:
                    digests.append("")
                    blobs.append(b"")
                    continue
                sums[:, i] = counts[:, units_].sum(1)
                digests.append(hashlib.sha256(";".join(text).encode()).hexdigest())
                blobs.append(units_.astype(np.uint32).tobytes())
                used.append(units_.astype(np.uint32))
            nulls = [pa.nulls(len(some), t) for t in (*[pa.list_(pa.int64())] * 2, *[pa.binary()] * 3)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), task + serial)), batch.column(0).slice(at, len(some)), *(pa.array(s) for s in sums), pa.array(digests, pa.string()), pa.array(blobs, pa.binary()), *nulls], names=_ROW)
            if len(slab.text) >= units or slab.places >= places:
                yield closed()
                slab, serial = None, serial + 1
    if slab is not None:
        yield closed()


def _answered(key, documents: pa.Table, answers: pa.Table) -> pa.Table:
    """Documents of a slab with n_best and count_sum, from the counts of its pairs."""
    kind = answers.column("kind").to_numpy()
    rows = answers.filter(pa.array(kind == 1))
    place = rows.column("place").to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], best[place] = rows.column("count").to_numpy(), rows.column("best").to_numpy()
    slab = answers.filter(pa.array(kind == 0))
    blob = lambda c: np.frombuffer(slab.column(c)[0].as_buffer(), np.uint32).astype(np.int64)
    unit, pair, n = (blob(c) for c in ("of_unit", "of_pair", "of_n")) if slab.num_rows else (np.zeros(0, np.int64),) * 3
    size = 1 + (int(unit.max()) if len(unit) else 0)
    by_unit = np.zeros((2, size), np.int64)
    np.add.at(by_unit[0], unit, n * best[pair])
    np.add.at(by_unit[1], unit, n * count[pair])
    sums = np.zeros((2, documents.num_rows), np.int64)
    for i, data in enumerate(documents.column("units")):
        own = np.frombuffer(data.as_buffer(), np.uint32)
        if len(own):
            sums[:, i] = by_unit[:, own].sum(1)
    out = {c: documents.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(out | {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1]), "groups_sha256": documents.column("groups_sha256")})


class Alignment:
    """Documents aligned, slab by slab, in the shared folder."""

    def __init__(self, docs: DataFrame, folder: str = FOLDER, units: int = UNITS, places: int = PLACES, memory: str = MEMORY):
        self.kind = dict(docs.dtypes)["doc_id"]
        schema = f"slab long, doc_id {self.kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, units binary, pairs array<long>, often array<long>, of_unit binary, of_pair binary, of_n binary"
        rows = cut(docs.select("doc_id", "text").mapInArrow(shipped(__name__, "_aligned_rows", folder, units, places, memory, None), schema), "align-rows")
        self.documents = rows.where("pairs is null").select("slab", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "units")
        again = docs.sparkSession.read.schema(rows.schema).parquet(rows.cut_path)  # with columns of its own, as both sides meet again
        self.slabs = again.where("pairs is not null").select("slab", "pairs", "often", "of_unit", "of_pair", "of_n")

    def pairs(self) -> DataFrame:
        """(a, b, n, best): how many links of the corpus hold each pair of ids, and whether no a has more with its b."""
        each = self.slabs.select(F.explode(F.arrays_zip("pairs", "often")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.often").alias("n"))
        named = cut(each.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "n").where("n > 0"), "align-pairs")
        most = named.groupBy("b").agg(F.max("n").alias("most"))
        return named.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))  # one row for each entry of b's vocabulary

    def measured(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
        asked = self.slabs.select("slab", F.posexplode("pairs").alias("place", "pair"))
        known = self.pairs().select((F.shiftleft("a", 32) + F.col("b")).alias("pair"), F.col("n").alias("count"), F.col("best").cast("long").alias("best"))
        counts = asked.join(known, "pair", "left").select("slab", F.lit(1).alias("kind"), "place", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("best", F.lit(0)).alias("best"), *(F.lit(None).cast("binary").alias(c) for c in ("of_unit", "of_pair", "of_n")))
        own = self.slabs.select("slab", F.lit(0).alias("kind"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("best"), "of_unit", "of_pair", "of_n")
        answers = counts.unionByName(own)
        schema = f"doc_id {self.kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
        return self.documents.groupBy("slab").cogroup(answers.groupBy("slab")).applyInArrow(_answers(), schema)


def _answers():
    run = shipped(__name__, "_answered_by_slab")

    def answered(key: tuple, documents: pa.Table, answers: pa.Table) -> pa.Table:
        return run((key, documents, answers))

    return answered


def _answered_by_slab(given) -> pa.Table:
    return _answered(*given)


def measured(docs: DataFrame, folder: str = FOLDER, units: int = UNITS, places: int = PLACES, memory: str = MEMORY) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text that is null, empty, no UTF-8 or not given back byte for byte by both tokenizers has no tokens: zeros and ''.
    Strings of special tokens in texts are plain text. Rows that repeat a doc_id, null ones too, stay separate rows and
    count each. Equal counts are all best. Other columns are not looked at. No rows, no result.
    """
    return Alignment(docs, folder, units, places, memory).measured()


def op11_token_alignment(spark, sf_dir) -> DataFrame:
    """Query: the byte-level and the piece vocabulary aligned over all documents."""
    return measured(spark.read.parquet(f"{sf_dir}/documents.parquet"))
