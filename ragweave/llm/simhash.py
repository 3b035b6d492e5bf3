"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared by exclusive-or and bit counts in numpy, tile against tile. A fingerprint's home is the
cell given by the population counts of its segments; two fingerprints at `radius` bits or fewer have counts whose
differences sum to `radius` or fewer, so tiles of cells further apart are never brought together. Cells of more
than `tile` fingerprints are split, so that a task holds one tile and streams the rest past it. Links stay within
the task that finds them: it sends on a spanning forest, not the pairs.

Fingerprints have 64 bits, or 64 * `words` bits. Wide ones have cells by steps of their whole population count, and
are compared by a part first: where that part alone differs in more than `radius` bits, the rest is not looked at.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import components, cut, joined_by, mixed, shipped, texts_of, without

TILE, STEP, BLOCK = 4096, 96, 1 << 17
SHINGLE, SIMILARITY = 5, 0.8


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of lower-cased words, repeats included; of fewer words, of the whole sequence."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hashed(b" ".join(words), 42)], np.uint64)
    grams = zip(*(words[i:] for i in range(shingle)))
    return np.fromiter((hashed(b" ".join(g), 42) for g in grams), np.uint64, len(words) - shingle + 1)


def bits_of(h: np.ndarray, words: int) -> np.ndarray:
    """SimHash of shingle hashes as `words` unsigned 64-bit words; of none, 0.

    The first word takes the hashes, each further one the hashes mixed with its number.
    """
    ones = np.zeros((words, 64), np.int64)
    for part in range(0, len(h), 1 << 12):
        some = h[part : part + (1 << 12)]
        for k in range(words):
            bits = np.unpackbits((mixed(some + np.uint64(k)) if k else some).astype("<u8")[:, None].view(np.uint8), axis=1, bitorder="little")
            # runs of 255 rows fit sums of one byte
            ones[k] += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def fingerprint(text: bytes, shingle: int = 3, words: int = 1) -> np.ndarray:
    """SimHash of word shingles, repeats counted; a text without words has 0."""
    return bits_of(shingle_hashes(text, shingle), words)


def _matrix(column: pa.Array) -> np.ndarray:
    """Fingerprints as rows of unsigned words: from a long, or from binaries of equal size."""
    if not pa.types.is_integer(column.type):
        found = texts_of(column)
        return np.frombuffer(b"".join(found), "<u8").reshape(len(found), len(found[0]) // 8 if found else 1)
    return column.to_numpy(zero_copy_only=False).view(np.uint64)[:, None]


def _column(prints: np.ndarray) -> pa.Array:
    n, words = prints.shape
    if words == 1:
        return pa.array(np.ascontiguousarray(prints[:, 0]).view(np.int64))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * words), n, [None, pa.py_buffer(np.ascontiguousarray(prints).tobytes())]).cast(pa.binary())


def _fingerprints(batches, shingle, words):
    for batch in batches:
        prints = [fingerprint(t, shingle, words) for t in texts_of(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), _column(np.stack(prints) if prints else np.zeros((0, words), np.uint64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1) -> DataFrame:
    """(doc_id, fp) of each row, fp as a signed long or, beyond one word, as binary; a null text is empty."""
    return docs.select("doc_id", "text").mapInArrow(shipped(__name__, "_fingerprints", shingle, words), f"doc_id {dict(docs.dtypes)['doc_id']}, fp {_kind(words)}")


def _kind(words: int) -> str:
    return "long" if words == 1 else "binary"


def _segments(segments: int) -> list[tuple[int, int]]:
    edges = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _cell(fp: np.ndarray, segments: int) -> np.ndarray:
    if fp.shape[1] > 1:
        return np.bitwise_count(fp).sum(1, dtype=np.int64) // STEP
    out = np.zeros(len(fp), np.int64)
    for at, width in _segments(segments):
        out = out * (width + 1) + np.bitwise_count((fp[:, 0] >> np.uint64(at)) & np.uint64((1 << width) - 1))
    return out


def _cells(batches, segments):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_cell(_matrix(batch.column(0)), segments))], names=["cell"])


def _steps(segments: int, radius: int) -> list[tuple[int, ...]]:
    """One of each two opposite steps between cells that may hold a link, without the step to the same cell."""
    found = [s for s in itertools.product(range(-radius, radius + 1), repeat=segments) if 0 < sum(map(abs, s)) <= radius]
    return [s for s in found if s > (0,) * segments]


def _scatter(batches, words, segments, radius, tiles_by_cell, limit):
    """Each fingerprint as owner in its own tile (role 0) and as visitor (role 1) where a link to it may be."""
    widths = [w for _, w in _segments(segments)] if words == 1 else [64 * words // STEP]
    moves = _steps(segments, radius) if words == 1 else [(i,) for i in range(1, -(-radius // STEP) + 1)]
    tiles = np.zeros(int(np.prod([w + 1 for w in widths])), np.int64)
    cells, counts = tiles_by_cell.value
    tiles[cells] = counts
    for batch in batches:
        fp = _matrix(batch.column(0))
        cell = _cell(fp, segments)
        own = (mixed(fp[:, 0]) % tiles[cell].astype(np.uint64)).astype(np.int64)
        keys, roles, prints = [cell * limit + own], [np.zeros(len(fp), np.int8)], [fp]

        def visit(at, where, first, n):
            """n tiles of each cell from the first on, and round to its tile 0."""
            rep = np.repeat(np.arange(len(at)), n)
            within = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
            keys.append(where[rep] * limit + (np.repeat(first, n) + within) % np.maximum(tiles[where[rep]], 1))
            roles.append(np.ones(len(rep), np.int8))
            prints.append(fp[at[rep]])

        everyone = np.arange(len(fp))
        # of two tiles of a cell one visits the other, and each is visited by as many
        n = tiles[cell]
        visit(everyone, cell, own + 1, (n - 1) // 2 + ((n % 2 == 0) & (own < n // 2)))
        digits, rest = [], cell.copy()
        for w in reversed(widths):
            digits.insert(0, rest % (w + 1))
            rest //= w + 1
        for move in moves:
            ok, where = np.ones(len(fp), bool), np.zeros(len(fp), np.int64)
            for d, w, s in zip(digits, widths, move):
                moved = d + s
                ok &= (moved >= 0) & (moved <= w)
                where = where * (w + 1) + moved
            at = everyone[ok]
            visit(at, where[ok], np.zeros(len(at), np.int64), tiles[where[ok]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(roles)), _column(np.concatenate(prints))], names=["key", "role", "fp"])


class _Tile:
    """The owners of one tile and the forest of links found so far."""

    def __init__(self, radius: int, words: int, half: int | None = None):
        self.radius, self.words, self.parts, self.own, self.edges = radius, words, [], None, []
        self.half = radius if half is None else half

    def add(self, fp: np.ndarray, visitors: bool) -> None:
        if not visitors:
            self.parts.append(fp)
            return
        self.close()
        self.compare(fp, None)

    def close(self) -> None:
        if self.own is None:
            self.own = np.concatenate(self.parts) if self.parts else np.zeros((0, self.words), np.uint64)
            self.columns = np.ascontiguousarray(self.own.T)
            self.root = np.arange(len(self.own))
            if len(self.own) > 1:
                self.compare(self.own, 0)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    def near(self, part: np.ndarray, same: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(row of part, own row) of each pair within the radius, in order; part is own[same:] unless same is None."""
        some = (self.words + 1) // 2
        apart = np.zeros((len(part), len(self.own)), np.uint16)
        for k in range(some):
            apart += np.bitwise_count(part[:, k, None] ^ self.columns[k][None, :])
        close = apart <= self.half
        if same is not None:
            close[np.arange(len(part)), np.arange(same, same + len(part))] = False
        v, o = np.nonzero(close)
        if self.words > some and len(v):
            held = [apart[v[i : i + BLOCK], o[i : i + BLOCK]] + np.bitwise_count(part[v[i : i + BLOCK], some:] ^ self.own[o[i : i + BLOCK], some:]).sum(1) <= self.radius for i in range(0, len(v), BLOCK)]
            v, o = v[np.concatenate(held)], o[np.concatenate(held)]
        return v, o

    def compare(self, other: np.ndarray, base: int | None) -> None:
        rows = max(1, BLOCK // max(1, len(self.own)))
        for at in range(0, len(other), rows):
            part = other[at : at + rows]
            v, o = self.near(part, None if base is None else at)
            if not len(v):
                continue
            self.root = self.settled()
            label = self.root[o]
            first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            head = np.minimum.reduceat(label, first)
            spread = np.repeat(head, np.diff(np.r_[first, len(v)]))
            pairs = np.unique(np.stack([label, spread], 1)[label != spread], axis=0)
            if base is not None:
                mine = np.stack([self.root[at + v[first]], head], 1)
                pairs = np.concatenate([pairs, mine[mine[:, 0] != mine[:, 1]]])
            else:
                self.edges.append(np.stack([part[v[first]], self.own[head]], 1))
            for a, b in pairs.tolist():
                a, b = self.find(a), self.find(b)
                if a != b:
                    self.root[max(a, b)] = min(a, b)

    def settled(self) -> np.ndarray:
        root = self.root
        while True:
            up = root[root]
            if np.array_equal(up, root):
                return up
            root = up

    def result(self) -> np.ndarray:
        self.close()
        root = self.settled()
        linked = np.flatnonzero(root != np.arange(len(root)))
        return np.concatenate([np.stack([self.own[linked], self.own[root[linked]]], 1), *self.edges]) if len(linked) or self.edges else np.zeros((0, 2, self.words), np.uint64)


def _compare(batches, words, radius, half):
    """Rows sorted by key and role; a tile's owners come before its visitors, which are never held together."""
    key, tile = None, None

    def rows(found):
        return pa.RecordBatch.from_arrays([_column(found[:, 0]), _column(found[:, 1])], names=["a", "b"])

    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        roles = batch.column(1).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        fp = _matrix(batch.column(2))
        cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]) | (roles[1:] != roles[:-1])) + 1, len(keys)].tolist()
        out = []
        for s, e in zip(cuts, cuts[1:]):
            if keys[s] != key:
                if tile is not None:
                    out.append(tile.result())
                key, tile = keys[s], _Tile(radius, words, half)
            tile.add(fp[s:e], bool(roles[s]))
        if out := [x for x in out if len(x)]:
            yield rows(np.concatenate(out))
    if tile is not None and len(found := tile.result()):
        yield rows(found)


def links(distinct: DataFrame, radius: int = 2, segments: int = 4, tile: int = TILE, words: int = 1, half: int | None = None) -> DataFrame:
    """(a, b): a spanning forest, tile by tile, of the links between distinct fingerprints (column fp).

    half: for more than one word, bits in which the first half may differ; without it, the radius, which drops no link.
    """
    spark, prints, kind = distinct.sparkSession, distinct.select("fp"), _kind(words)
    counts = prints.mapInArrow(shipped(__name__, "_cells", segments), "cell long").groupBy("cell").count().collect()  # at most one row for each cell
    limit = 1 << 40
    sizes = (np.array([r[0] for r in counts], np.int64), np.array([-(-r[1] // tile) for r in counts], np.int64))
    sent = prints.mapInArrow(shipped(__name__, "_scatter", words, segments, radius, spark.sparkContext.broadcast(sizes), limit), f"key long, role byte, fp {kind}")
    dealt = sent.repartition("key").sortWithinPartitions("key", "role")
    return dealt.mapInArrow(shipped(__name__, "_compare", words, radius, half), f"a {kind}, b {kind}")


def groups(docs: DataFrame, shingle: int = 3, radius: int = 2, segments: int = 4, tile: int = TILE, words: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (the least doc_id that links reach, its own included).

    Null texts and texts without words share fingerprint 0 and are linked like any other. Rows that repeat a
    doc_id stay separate rows. A null doc_id never is a component's id unless all of its doc_ids are null. No rows, no
    result.
    """
    prints = cut(fingerprints(docs, shingle, words), "simhash-fp")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    found = components(links(distinct, radius, segments, tile, words), "simhash")
    member = cut(found.withColumnRenamed("v", "fp").join(distinct, "fp"), "simhash-member")
    lowest = member.groupBy("root").agg(F.min("least").alias("lowest"))
    named = distinct.join(member.join(lowest, "root").select("fp", "lowest"), "fp", "left").select("fp", "n", F.coalesce("lowest", "least").alias("component_id"))
    return joined_by(prints, named, ["fp"], "n", prints.count()).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2, segments: int = 4, tile: int = TILE, words: int = 1) -> DataFrame:
    """docs without the rows whose group has a document of a smaller doc_id; of rows with that doc_id all stay.

    Rows without a doc_id stay; null texts and texts without words are one group. Columns of any name stay as they are.
    """
    return without(docs, groups(docs, shingle, radius, segments, tile, words).where("doc_id <> component_id"))


def _set_prints(batches, shingle):
    for batch in batches:
        sets = jaccard.sets_of(batch.column(0), shingle)
        prints = [bits_of(own, 1) for own in sets]
        yield pa.RecordBatch.from_arrays([pa.array([jaccard.short_name(own) for own in sets], pa.int64()), _column(np.stack(prints) if prints else np.zeros((0, 1), np.uint64))], names=["set", "fp"])


def near_sets(texts: DataFrame, shingle: int = SHINGLE, radius: int = 2, segments: int = 4, tile: int = TILE) -> DataFrame:
    """(a, b): names of sets whose fingerprints are linked; sets of one fingerprint by the least of them."""
    prints = cut(texts.select("text").mapInArrow(shipped(__name__, "_set_prints", shingle), "set long, fp long").distinct(), "alike-fp")
    first = cut(prints.groupBy("fp").agg(F.min("set").alias("head"), F.count("*").alias("n")), "alike-heads")
    found = links(first, radius, segments, tile).join(first.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select("x", "y")
    return joined_by(prints, first.where("n > 1"), ["fp"], "n", prints.count()).select("set", "head").union(found)


def alike(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, component_id (the least doc_id that links reach, its own included).

    Two documents are linked if their sets of distinct shingles have a Jaccard similarity of `similarity` or more, in
    hundredths. Candidates are sets whose fingerprints are at 2 bits or fewer, by tiles, and sets that share one of their
    first shingles (see jaccard), so that none is missed; the sets themselves decide. Null texts and texts without words
    have empty sets, which are alike. doc_ids are treated as in groups().
    """
    found = cut(jaccard.linked(docs, round(100 * similarity), shingle, more=functools.partial(near_sets, shingle=shingle)), "alike")
    least = found.where("n_shingles = 0").agg(F.min("doc_id").alias("_least"))  # one row
    empty = F.when(F.col("n_shingles") == 0, F.coalesce("_least", "doc_id")).otherwise(F.col("component_id"))
    return found.crossJoin(F.broadcast(least)).select("doc_id", empty.alias("component_id"))


def keep_one_alike(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """docs without the rows that alike() links to a document of a smaller doc_id: copies with edits go as well.

    Of rows that share the least doc_id all stay, and so do rows without a doc_id. Null texts and texts without words
    are alike, so one of them stays. Columns of any name stay as they are; no rows, no result.
    """
    return without(docs, alike(docs, similarity, shingle).where("doc_id <> component_id"))


def op1_simhash(spark, sf_dir) -> DataFrame:
    """Query: fingerprints of 3-word shingles, linked at 2 bits or fewer, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
