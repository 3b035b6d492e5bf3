"""Joins of documents by the exact Jaccard similarity of their sets of word n-grams.

Sets that can link share a shingle among their first ones: in one fixed order of all shingles, the first
n - ceil(p * n / 100) + 1 of a set of n. In that order shingles that several sets of the corpus hold come last, as a filter
of fixed size tells that is made of the counts of all shingles: so passages that documents share bring no sets together
unless they make up most of them, and where the filter knows all shared shingles the others need not be looked at. The
order decides how much is compared, never what links.

Sets that share such a shingle, in a chain of sizes that may link, are candidates, and their components are cut into
tiles: a component of more than `tile` bytes by bands of size, a band by hash. Sets whose sizes lie in one band or in
neighbouring ones meet, the others never. In a tile, hashed bitmaps of the sets are compared first: the bits in which two
differ bound their overlap from above. What the bound leaves is decided by intersecting the sorted sets. Links stay in
the task that finds them: it sends on a spanning forest.

A shingle is a 64-bit hash of its words' hashes, a set's name the 128-bit digest of its sorted shingles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, components, cut, given_back, joined_by, lowered, mixed, prefix_sums, ranges_hashed, shipped, slices, trimmed, words_in

#: TILE is bytes of sets that a task holds at once, FILTER the bits of the filter as a power of two, of which one in eight
#: may stand for a shared shingle; shingles of CROWD sets or more are dealt to several tasks. RUN shingles are counted at a
#: time, in ranges of about as many each, of which there are at most PARTS.
SHINGLE, PERCENT, TILE, FILTER, CROWD, RUN, PARTS, SLICE, BLOCK = 5, 80, 16 << 20, 27, 100_000, 1 << 20, 1 << 18, 2 << 20, 1 << 24
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def bands(percent: int, most: int = 1 << 40) -> list[int]:
    """First sizes of the bands: a set links only to sets of its own band and of the two beside it."""
    edges = [1]
    while edges[-1] < most:
        edges.append(edges[-1] * 100 // percent + 1)
    return edges


def prefix_size(n: int, percent: int) -> int:
    """How many of its first shingles a set of n needs so that any set that links to it shares one with them."""
    return n - -(-percent * n // 100) + 1


def _sets(raw: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """For each text its distinct shingles, sorted; of fewer words than a shingle the one sequence of all, of none nothing."""
    out: list[np.ndarray] = []
    for a, b in slices(offsets, SLICE):
        low = lowered(raw[offsets[a] : offsets[b]])
        start, end, row = words_in(low, offsets[a : b + 1] - offsets[a])
        words = ranges_hashed(prefix_sums(low), start, end)
        first = np.searchsorted(row, np.arange(b - a + 1)).tolist()
        with np.errstate(over="ignore"):
            whole = np.zeros(max(0, len(words) - shingle + 1), np.uint64)
            for k in range(shingle):
                whole += mixed(words[k : len(words) - shingle + 1 + k] * _ODD[k % 5] + np.uint64(k))
            whole = mixed(whole + np.uint64(shingle))
            for i, j in zip(first, first[1:]):
                if j - i >= shingle:
                    out.append(np.unique(whole[i : j - shingle + 1]))
                elif j > i:
                    few = np.uint64(j - i)
                    for k in range(j - i):
                        few += mixed(words[i + k] * _ODD[k % 5] + np.uint64(k))
                    out.append(np.array([mixed(few)], np.uint64))
                else:
                    out.append(np.zeros(0, np.uint64))
    return out


def _name(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def _packed(x: np.ndarray, dtype) -> bytes:
    """Numbers byte plane by byte plane, which the shuffle's compression shortens well."""
    x = np.ascontiguousarray(x.astype(dtype))
    return x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def _unpacked(data: pa.Scalar, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data.as_buffer(), np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _short(name: bytes) -> int:
    """A set's name as a long, for candidates: two sets of one short name are candidates together."""
    return int.from_bytes(name[:8], "little", signed=True)


def short_name(own: np.ndarray) -> int:
    return _short(_name(own))


def sets_of(column: pa.Array, shingle: int) -> list[np.ndarray]:
    """The set of each text of a column, as sorted hashes of its distinct shingles."""
    return _sets(*buffer_of(column), shingle)


def _prints(batches, shingle):
    """(doc_id, th, sid, short, n) of each row."""
    for batch in trimmed(batches):
        sets = _sets(*buffer_of(batch.column(2)), shingle)
        names = [_name(s) for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(map(_short, names), pa.int64()), pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "th", "sid", "short", "n"])


def _folded(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, in order; their counts)."""
    if counts is None:
        keys = np.sort(keys)
        counts = np.ones(len(keys), np.int64)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


_COUNTED = ["part", "keys", "often"]


def _row(part: int, keys: np.ndarray, often: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_packed(np.diff(keys, prepend=np.uint64(0)), np.uint64)], pa.binary()), pa.array([_packed(often, np.uint32)], pa.binary())], names=_COUNTED)


def _keys(data: pa.Scalar) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64), dtype=np.uint64)


def _counted(batches, shingle, bits, parts):
    """(part, keys, often): the first `bits` bits of shingles, RUN at a time, and how many sets of the task have them."""
    seen: set[int] = set()
    held: list[np.ndarray] = []
    size = 0

    def rows():
        keys, often = _folded(np.concatenate(held) >> np.uint64(64 - bits))
        edges = np.searchsorted(keys, np.arange(parts, dtype=np.uint64) << np.uint64(bits - parts.bit_length() + 1)).tolist()
        for p, (a, b) in enumerate(zip(edges, [*edges[1:], len(keys)])):
            if a < b:
                yield _row(p, keys[a:b], often[a:b])

    for batch in trimmed(batches):
        for own in _sets(*buffer_of(batch.column(0)), shingle):
            name = _short(_name(own))
            if len(own) and name not in seen:
                seen.add(name)
                held.append(own)
                size += len(own)
        if size > RUN:
            yield from rows()
            held, size = [], 0
    if held:
        yield from rows()


def _shared(batches):
    """Of rows sorted by part, the keys of each that two sets or more have."""
    part, held, size = None, [], 0

    def fold():
        return _folded(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))

    def row():
        keys, often = fold()
        return _row(part, keys[often > 1], np.minimum(often[often > 1], (1 << 32) - 1))

    for batch in trimmed(batches):
        for p, keys, often in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if p != part:
                if held:
                    yield row()
                part, held, size = p, [], 0
            held.append((_keys(keys), _unpacked(often, np.uint32).astype(np.int64)))
            size += len(held[-1][0])
            if size > 2 * RUN and len(held) > 1:
                held, size = [fold()], 0
    if held:
        yield row()


def _levels(batches):
    """(level, n): how many keys have counts of 2**level or more."""
    total = np.zeros(32, np.int64)
    for batch in batches:
        for often in batch.column(2):
            total += np.bincount(np.log2(_unpacked(often, np.uint32)).astype(np.int64), minlength=32)
    yield pa.RecordBatch.from_arrays([pa.array(range(32), pa.int32()), pa.array(np.cumsum(total[::-1])[::-1])], names=["level", "n"])


def _filtered(batches, bits, parts, least, crowd, size):
    """(part, filter, hot, often): the part's share of the filter, and its keys of `crowd` sets or more."""
    each = max(8, (1 << size) // parts)
    for batch in batches:
        for p, keys, often in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            keys, often = _keys(keys), _unpacked(often, np.uint32).astype(np.int64)
            mask = np.zeros(each, np.uint8)
            mask[((keys[often >= least] >> np.uint64(bits - size)) - np.uint64(p * each)).astype(np.int64)] = 1
            hot = often >= crowd
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(mask, bitorder="little").tobytes()], pa.binary()), pa.array([keys[hot].view(np.int64)], pa.list_(pa.int64())), pa.array([often[hot]], pa.list_(pa.int64()))], names=["part", "filter", "hot", "often"])


class Order:
    """The order of shingles: those that the filter does not know first, each kind by hash."""

    def __init__(self, mask: np.ndarray, size: int, complete: bool, bits: int, hot: np.ndarray, often: np.ndarray, crowd: int):
        self.mask, self.size, self.complete, self.bits, self.hot, self.often, self.crowd = mask, size, complete, bits, hot, often, crowd

    def first(self, own: np.ndarray, n: int) -> np.ndarray:
        """The first n of a set, without those that no other set can have."""
        at = (own >> np.uint64(64 - self.size)).astype(np.int64)
        shared = (self.mask[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        first = np.argsort(shared, kind="stable")[:n]
        return own[first[shared[first] > 0]] if self.complete else own[first]

    def tasks(self, keys: np.ndarray) -> np.ndarray:
        """Among how many tasks the sets of each shingle are dealt."""
        out = np.ones(len(keys), np.int64)
        if len(self.hot):
            short = keys >> np.uint64(64 - self.bits)
            place = np.minimum(np.searchsorted(self.hot, short), len(self.hot) - 1)
            out += np.where(self.hot[place] == short, self.often[place] // self.crowd, 0)
        return out


def ordered(texts: DataFrame, shingles: int, shingle: int, crowd: int, size: int) -> Order:
    """The order of shingles by the counts of all, which are made in ranges of hash; the driver sees the filter and at
    most a million crowded keys."""
    bits = min(64, max(40, shingles.bit_length() + 13))
    parts = min(1 << size - 3, PARTS, 1 << max(4, (shingles // RUN).bit_length()))
    counted = texts.select("text").mapInArrow(shipped(__name__, "_counted", shingle, bits, parts), "part int, keys binary, often binary")
    shared = cut(counted.repartition(min(parts, 50_000), "part").sortWithinPartitions("part").mapInArrow(shipped(__name__, "_shared"), "part int, keys binary, often binary"), "jaccard-shared")
    levels = {r["level"]: r["n"] for r in shared.mapInArrow(shipped(__name__, "_levels"), "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()}  # 32 rows
    level = next(i for i in range(1, 33) if levels.get(i, 0) <= (1 << size) // 8)
    crowd = max(crowd, shingles >> 20)
    rows = shared.mapInArrow(shipped(__name__, "_filtered", bits, parts, 1 << level, crowd, size), "part int, filter binary, hot array<long>, often array<long>").collect()  # 2**size bits in all
    mask, each = np.zeros((1 << size) // 8, np.uint8), max(8, (1 << size) // parts) // 8
    for r in rows:
        mask[r["part"] * each : (r["part"] + 1) * each] = np.frombuffer(r["filter"], np.uint8)
    hot = sorted((k % (1 << 64), n) for r in rows for k, n in zip(r["hot"], r["often"]))
    del rows
    given_back()
    return Order(mask, size, level == 1, bits, np.array([k for k, _ in hot], np.uint64), np.array([n for _, n in hot], np.int64), crowd)


def _entries(batches, shingle, percent, shared):
    """(shingle, salt, n, set): the first shingles of each set that this task meets.

    salt: 0, or from 1 the task among which the sets of a crowded shingle are dealt.
    """
    seen: set[int] = set()
    order = shared.value
    for batch in trimmed(batches):
        keys, salts, sizes, names = [], [], [], []
        for own in _sets(*buffer_of(batch.column(0)), shingle):
            if not len(own) or (name := _short(_name(own))) in seen:
                continue
            seen.add(name)
            first = order.first(own, prefix_size(len(own), percent))
            tasks = order.tasks(first)
            keys.append(first)
            salts.append(np.where(tasks > 1, 1 + name % tasks, 0))
            sizes.append(np.full(len(first), len(own)))
            names.append(np.full(len(first), name))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(salts), pa.int32()), pa.array(np.concatenate(sizes), pa.int64()), pa.array(np.concatenate(names), pa.int64())], names=["shingle", "salt", "n", "set"])


def _chained(batches, percent):
    """Rows sorted by shingle, salt and size: (a, b) of neighbours whose sizes may link, and for crowded shingles
    (shingle, band, a) of the first set of each band, with which the parts of a shingle are joined again."""
    last, edges = None, np.array(bands(percent))
    for batch in batches:
        key, salt, n, name = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(key):
            continue
        if last is not None:
            key, salt, n, name = (np.r_[x, y] for x, y in zip(last, (key, salt, n, name)))
        same = (key[1:] == key[:-1]) & (salt[1:] == salt[:-1])
        near = np.flatnonzero(same & (100 * n[:-1] >= percent * n[1:]) & (name[1:] != name[:-1]))
        pairs = np.unique(np.stack([name[near], name[near + 1]], 1), axis=0)
        band = np.searchsorted(edges, n, side="right") - 1
        # a chain breaks inside a band only with its key, so the first of each band stands for the chain there
        head = np.flatnonzero((np.r_[last is None, ~same | (band[1:] != band[:-1])]) & (salt > 0))
        last = key[-1:], salt[-1:], n[-1:], name[-1:]
        nulls = lambda x, t: pa.nulls(len(x), t)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[pairs[:, 0], name[head]]), pa.concat_arrays([pa.array(pairs[:, 1]), nulls(head, pa.int64())]), pa.concat_arrays([nulls(pairs, pa.int64()), pa.array(key[head])]), pa.concat_arrays([nulls(pairs, pa.int32()), pa.array(band[head], pa.int32())])], names=["a", "b", "shingle", "band"])


def _named_sets(batches, shingle):
    """(sid, shingles) of each text that this task has not met before; equal texts have equal th."""
    seen: set[int] = set()
    for batch in trimmed(batches):
        th = batch.column(0).to_pylist()
        fresh = [i for i, t in enumerate(th) if not (t in seen or seen.add(t))]
        sets = _sets(*buffer_of(batch.column(1).take(pa.array(fresh, pa.int64()))), shingle)
        yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "shingles"])


class Tile:
    """Sets that a task holds, linked among themselves, and asked by the sets that visit."""

    def __init__(self, percent: int):
        self.percent, self.sids, self.sets, self.n = percent, [], [], None

    def add(self, sid: bytes, own: np.ndarray) -> None:
        self.sids.append(sid)
        self.sets.append(own)

    def bitmap(self, sets: list[np.ndarray]) -> np.ndarray:
        """Rows of words: the bits that the shingles of each set hash to."""
        out = np.empty((len(sets), self.bits // 64), np.uint64)
        step = max(1, BLOCK // self.bits)
        for at in range(0, len(sets), step):
            some = sets[at : at + step]
            held = np.zeros((len(some), self.bits), np.uint8)
            place = (np.concatenate(some) >> np.uint64(20)).astype(np.int64) & (self.bits - 1)
            held[np.repeat(np.arange(len(some)), [len(s) for s in some]), place] = 1
            out[at : at + step] = np.packbits(held, axis=1).view(np.uint64)
        return out

    def close(self) -> None:
        """Bitmaps, and the root of each set by the links among them: what a set reaches leaves the others at once."""
        if self.n is not None:
            return
        self.n = np.array([len(s) for s in self.sets], np.int64)
        self.starts = np.r_[0, np.cumsum(self.n)]
        self.values = np.concatenate(self.sets)
        self.sets = [self.values[a:b] for a, b in zip(self.starts, self.starts[1:])]
        # about four bits for each shingle of a usual set
        self.bits = 1 << min(16, max(7, int(4 * self.n.mean()).bit_length()))
        self.maps = self.bitmap(self.sets)
        self.root = np.arange(len(self.sets))
        left = self.root.copy()
        while len(left) > 1:
            seed, ahead = int(left[0]), [int(left[0])]
            left = left[1:]
            while ahead and len(left):
                at = ahead.pop()
                near = self.linked(self.sets[at], self.maps[at], left)
                if len(near):
                    self.root[near] = seed
                    ahead += near.tolist()
                    left = np.setdiff1d(left, near, assume_unique=True)
        own, size = np.unique(self.root, return_counts=True)
        self.roots = own[np.argsort(-size, kind="stable")]

    def bounded(self, n: int, bits: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Those whose overlap may suffice: it is at most half of both sizes less the bits in which the bitmaps differ."""
        p, m = self.percent, self.n[among]
        among = among[100 * np.minimum(m, n) >= p * np.maximum(m, n)]
        if not len(among):
            return among
        m = self.n[among]
        apart = np.bitwise_count(self.maps[among] ^ bits).sum(1, dtype=np.int64)
        return among[(100 + p) * ((m + n - apart) // 2) >= p * (m + n)]

    def exact(self, own: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Those of among that link to the sorted set own, by the size of their intersection."""
        if not len(among):
            return among
        n, parts = self.n[among], [self.sets[i] for i in among.tolist()]
        values = np.concatenate(parts)
        hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
        shared = np.add.reduceat(hit, np.r_[0, np.cumsum(n)[:-1]], dtype=np.int64)
        return among[(100 + self.percent) * shared >= self.percent * (n + len(own))]

    def linked(self, own: np.ndarray, bits: np.ndarray, among: np.ndarray) -> np.ndarray:
        return self.exact(own, self.bounded(len(own), bits, among))

    def visited(self, own: np.ndarray) -> list[int]:
        """One held set of each component that own links to."""
        self.close()
        found, open_ = [], self.roots
        head = open_[:8]  # the largest components are asked by their first set
        some = head[100 * np.minimum(self.n[head], len(own)) >= self.percent * np.maximum(self.n[head], len(own))]
        found += self.exact(own, some).tolist()
        rest = np.flatnonzero(~np.isin(self.root, found)) if found else np.arange(len(self.n))
        rest = self.bounded(len(own), self.bitmap([own])[0], rest)
        step = 1
        while len(rest):
            # one set of each open component first, then more of them at a time
            rank = np.argsort(self.root[rest], kind="stable")
            comp = self.root[rest][rank]
            begin = np.r_[True, comp[1:] != comp[:-1]]
            within = np.arange(len(comp)) - np.maximum.accumulate(np.where(begin, np.arange(len(comp)), 0))
            now = rest[rank[within < step]]
            got = self.exact(own, now)
            _, first = np.unique(self.root[got], return_index=True)
            found += got[first].tolist()
            rest = rest[rank[within >= step]]
            rest = rest[~np.isin(self.root[rest], self.root[got])]
            step *= 4
        return found


def _linked(batches, percent):
    """Rows sorted by tile and role, owners before visitors: (a, b) of a spanning forest of the links in each tile."""
    key, tile, out = None, None, []

    def rows():
        nonlocal out
        done, out = out, []
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in done], pa.binary()), pa.array([b for _, b in done], pa.binary())], names=["a", "b"])

    def closed():
        if tile.sids:
            tile.close()
            out.extend((tile.sids[i], tile.sids[tile.root[i]]) for i in np.flatnonzero(tile.root != np.arange(len(tile.root))).tolist())

    for batch in batches:
        keys = [batch.column(0).to_pylist(), batch.column(1).to_pylist()]
        for *k, role, sid, data in zip(*keys, batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
            if k != key:
                if tile is not None:
                    closed()
                key, tile = k, Tile(percent)
            own = np.frombuffer(data.as_buffer(), np.uint64)
            if role == 0:
                tile.add(sid, own.copy())
            elif tile.sids:
                out.extend((sid, tile.sids[i]) for i in tile.visited(own))
        if out:
            yield rows()
    if tile is not None:
        closed()
    if out:
        yield rows()


def _tiled(members: DataFrame, percent: int, tile: int) -> DataFrame:
    """(group, part, role, sid): the tile that holds each set (role 0) and those that it visits (role 1).

    members: (sid, n, group). A group of at most `tile` bytes is one tile; a larger one has tiles for each band of size.
    Of two tiles of a band one visits the other, and each is visited by as many; a band's sets visit all tiles of the next.
    """
    edges = bands(percent)
    band = F.lit(0)
    for at in range(0, len(edges), 8):  # sizes in eight steps of a band index at a time keep the expression shallow
        band = band + F.size(F.filter(F.array(*(F.lit(e) for e in edges[at : at + 8])), lambda e: e <= F.col("n")))
    rows = members.withColumn("band", (band - 1).cast("int"))
    sizes = rows.groupBy("group", "band").agg(F.sum(8 * F.col("n")).alias("bytes"), F.count("*").alias("rows"))
    whole = sizes.groupBy("group").agg(F.sum("bytes").alias("total"), F.sum("rows").alias("members"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("bytes") / tile).cast("int").alias("t")))).alias("tiles"))  # one entry a band, of which there are about a hundred
    rows = joined_by(rows, whole.where("members > 1"), ["group"], "members", members.count())
    salt = lambda n: F.pmod(F.xxhash64("sid"), n).cast("int")
    small = rows.where(F.col("total") <= tile).select("group", F.lit(-1).cast("long").alias("part"), F.lit(0).cast("byte").alias("role"), "sid")
    rows = rows.where(F.col("total") > tile).withColumn("t", F.element_at("tiles", F.col("band"))).withColumn("own", salt(F.col("t")))
    part = lambda band, t: band.cast("long") * F.lit(1 << 32) + t
    place = lambda band, t, role: F.struct(part(band, t).alias("part"), F.lit(role).cast("byte").alias("role"))
    half = F.floor((F.col("t") - 1) / 2).cast("int") + ((F.col("t") % 2 == 0) & (F.col("own") < F.floor(F.col("t") / 2))).cast("int")
    seq = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    inside = F.transform(seq(half), lambda i: place(F.col("band"), F.pmod(F.col("own") + i, F.col("t")), 1))
    above = F.transform(seq(F.coalesce(F.element_at("tiles", F.col("band") + 1), F.lit(0))), lambda i: place(F.col("band") + 1, i - 1, 1))
    sent = rows.select("group", "sid", F.explode(F.concat(F.array(place(F.col("band"), F.col("own"), 0)), inside, above)).alias("p"))
    return small.unionByName(sent.select("group", F.col("p.part").alias("part"), F.col("p.role").alias("role"), "sid"))


def linked(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, tile: int = TILE, crowd: int = CROWD, size: int = FILTER, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the least doc_id that links reach, its own included).

    Two documents link if the intersection of their sets of distinct shingles is at least `percent` hundredths of the
    union. A text of fewer words than a shingle is one shingle; null texts and texts without words have empty sets,
    which link to nothing, not even to each other. Rows that repeat a doc_id stay separate rows. A null doc_id never is
    a component's id unless all of its doc_ids are null. Other columns of docs are not looked at. No rows, no result.
    more: further candidates, from a frame with the column text to pairs (a, b) of short_name().
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    seen = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    prints = cut(seen.mapInArrow(shipped(__name__, "_prints", shingle), f"doc_id {kind}, th long, sid binary, short long, n long"), "jaccard-prints")
    rows, shingles = prints.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    sets = cut(prints.groupBy("sid", "short", "n").agg(F.min("doc_id").alias("least"), F.min("th").alias("th"), F.count("*").alias("copies")), "jaccard-sets")
    order = ordered(seen, shingles, shingle, crowd, size)
    shared = spark.sparkContext.broadcast(order)
    del order
    given_back()
    entries = seen.select("text").mapInArrow(shipped(__name__, "_entries", shingle, percent, shared), "shingle long, salt int, n long, set long")
    dealt = entries.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "n", "set")
    near = cut(dealt.mapInArrow(shipped(__name__, "_chained", percent), "a long, b long, shingle long, band int"), "jaccard-near")
    heads = near.where("b is null").groupBy("shingle", "band").agg(F.min("a").alias("a"))
    beside = heads.select("shingle", (F.col("band") + 1).alias("band"), F.col("a").alias("b"))
    same = near.where("b is null").drop("b").join(heads.withColumnRenamed("a", "b"), ["shingle", "band"])
    edges = near.where("b is not null").select("a", "b").union(same.select("a", "b")).union(heads.join(beside, ["shingle", "band"]).select("a", "b"))
    if more:
        edges = edges.union(more(seen))
    groups = components(edges, "jaccard-near").withColumnRenamed("v", "short").withColumnRenamed("root", "group")
    members = cut(sets.join(groups, "short").select("sid", "n", "th", "group"), "jaccard-members")
    texts = seen.select("th", "text").join(members.select("th").distinct(), "th", "left_semi")
    held = texts.mapInArrow(shipped(__name__, "_named_sets", shingle), "sid binary, shingles binary").groupBy("sid").agg(F.first("shingles").alias("shingles"))
    sent = _tiled(members.select("sid", "n", "group"), percent, tile).join(held, "sid").select("group", "part", "role", "sid", "shingles").repartition("group", "part").sortWithinPartitions("group", "part", "role", "sid")
    forest = cut(sent.mapInArrow(shipped(__name__, "_linked", percent), "a binary, b binary"), "jaccard-links")
    found = components(forest, "jaccard").withColumnRenamed("v", "sid")
    member = cut(found.join(sets, "sid").select("sid", "root", "least"), "jaccard-linked")
    lowest = member.groupBy("root").agg(F.min("least").alias("lowest"))
    # an empty set links to nothing, so its documents stand alone
    ids = sets.where("n > 0").join(member.join(lowest, "root").select("sid", "lowest"), "sid", "left").select("sid", "copies", F.coalesce("lowest", "least").alias("component_id"))
    full, empty = prints.where("n > 0"), prints.where("n = 0")
    named = joined_by(full, ids, ["sid"], "copies", rows).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return named.unionByName(empty.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op13_jaccard_join(spark, sf_dir) -> DataFrame:
    """Query: documents linked by a similarity of 0.8 of their sets of 5-word shingles."""
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every pair of documents that share a shingle meets, which whole tables of some gigabytes do not allow; for smaller ones.
SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {SHINGLE} THEN [array_to_string(w[i:i + {SHINGLE - 1}], ' ') FOR i IN range(1, len(w) - {SHINGLE - 2})] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least.b AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) least ON least.a = d.doc_id
"""
