"""Language-model scores from an n-gram trie in Elias-Fano levels.

Level 1 is the vocabulary: hashes of words, in ranges of hash. Level k holds the k-grams under their contexts, which
are nodes of level k-1. Pairs are dealt to shards by their first word, longer ones to the shard in which their context
stands, so that a context's node is looked up where the shard is built and not by those who count; a context that fills
more than a quarter of a shard is spread by k-gram. A shard is one file in the shared folder: contexts, monotone pointers to their successors, successors relative
to their context (each context's values follow the last value before it), and quantised discounted probabilities and
back-off weights. Workers map the files they ask, and never copy them to memory.

Probabilities interpolate absolute discounts: P(w | h) = max(c(hw) - D, 0) / c(h) + D n(h) / c(h) * P(w | shorter h).
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, crc32_text, fresh_path, lowered, mixed, prefix_sums, ranges_hashed, shipped, slices, trimmed, words_in
from .eliasfano import Sequence, packed

#: SHARD_BYTES is text for each shard: building one takes some twenty times the size of its keys in memory.
ORDER, DISCOUNT, SLICE, SHARD_BYTES, FLOOR, TASKS, LEAST_WIDE, ASKED, SCORED = 3, 0.75, 2 << 20, 10 << 20, 1e-8, 50_000, 1000, 1 << 17, 4 << 20
END = np.uint64(0x0E4D0E4D0E4D0E4D)


def quantised(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities on a logarithmic scale from FLOOR to 1; 0 stays 0."""
    code = 1 + np.round((np.log10(np.maximum(p, FLOOR)) - np.log10(FLOOR)) / -np.log10(FLOOR) * 65534)
    return np.where(p > 0, code, 0).astype(np.uint16)


_DECODED = np.r_[0.0, 10 ** (np.log10(FLOOR) * (1 - np.arange(65535) / 65534))]


def _local(uri: str) -> str | None:
    return uri[7:] if uri.startswith("file://") else uri[5:] if uri.startswith("file:") else uri if uri.startswith("/") else None


def save(uri: str, words: np.ndarray) -> None:
    """Whole or not at all, so that a task may run twice."""
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        store, where = fs.FileSystem.from_uri(uri)
        with store.open_output_stream(where) as f:
            f.write(words.tobytes())
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    words.tofile(part)
    os.replace(part, path)


_maps: dict[str, np.ndarray] = {}


def mapped(uri: str) -> np.ndarray:
    """The words of a saved file, memory-mapped; from a store that cannot be mapped, by way of a cached copy."""
    if uri not in _maps:
        path = _local(uri)
        if path is None:
            import tempfile

            from pyarrow import fs

            store, where = fs.FileSystem.from_uri(uri)
            path = os.path.join(tempfile.gettempdir(), uuid.uuid5(uuid.NAMESPACE_URL, uri).hex)
            if not os.path.exists(path):
                with store.open_input_stream(where) as f, open(f"{path}.{os.getpid()}", "wb") as g:
                    while block := f.read(1 << 22):
                        g.write(block)
                os.replace(f"{path}.{os.getpid()}", path)
        _maps[uri] = np.memmap(path, np.uint64, "r").view(np.ndarray)  # mapped all the same, without the cost of a subclass
    return _maps[uri]


class Vocabulary:
    """Words by hash; ids run through the shards, which are ranges of hash."""

    def __init__(self, folder: str, bits: int, starts: np.ndarray):
        self.folder, self.bits, self.starts = folder, bits, starts

    def shard_of(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of sorted hashes."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        edges = np.searchsorted(self.shard_of(h), np.arange(len(self.starts) + 1))
        for s, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            if a < b and self.starts[s] >= 0:
                words = mapped(f"{self.folder}/level-1-{s}")
                seq = Sequence(words)
                at = seq.find(h[a:b] >> np.uint64(1))
                ok = at >= 0
                ids[a:b][ok] = at[ok] + self.starts[s]
                counts[a:b][ok] = words[seq.end : seq.end + seq.n].view(np.int64)[at[ok]]
        return ids, counts


class Level:
    """The k-grams of one order: node ids run through the shards. below: the level of their contexts, or None of words."""

    def __init__(self, folder: str, order: int, shards: int, size: int, starts: np.ndarray, wide: dict[int, int], weights: dict[int, float], below: Level | None):
        self.folder, self.order, self.shards, self.size, self.starts, self.below = folder, order, shards, size, starts, below
        self.wide = np.array(sorted(wide), np.int64)
        self.weights = np.array([weights.get(w, 1.0) for w in self.wide.tolist()])
        self.held = np.flatnonzero(starts >= 0)

    def home(self, node: np.ndarray) -> np.ndarray:
        """The shard in which each node stands."""
        return self.held[np.searchsorted(self.starts[self.held], node, side="right") - 1]

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node or -1, discounted probability, back-off weight of the context) of distinct pairs, given in order."""
        node = np.full(len(word), -1, np.int64)
        p, weight = np.zeros(len(word)), np.ones(len(word))
        shard = route(context, word, self.size, self.shards, self.wide, self.below)
        order = np.argsort(shard.astype(np.uint16) if self.shards <= 1 << 16 else shard, kind="stable")  # numbers of two bytes are sorted by digits
        edges = np.r_[0, np.cumsum(np.bincount(shard, minlength=self.shards))]
        value = (word + 1).astype(np.uint64)
        for s in np.flatnonzero(np.diff(edges)).tolist():
            if self.starts[s] < 0:
                continue
            at = order[edges[s] : edges[s + 1]]
            contexts, pointers, successors, tail = self.opened(s)
            asked = context[at]
            new = np.r_[True, asked[1:] != asked[:-1]]
            own, back = asked[new], np.cumsum(new) - 1
            row = contexts.find(own.astype(np.uint64))
            held = np.flatnonzero(row >= 0)
            first, last = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            first[held], last[held] = pointers.pairs(row[held])
            base = np.zeros(len(own), np.uint64)
            later = held[first[held] > 0]
            base[later] = successors[first[later] - 1]
            if len(held) < len(own):
                ask = np.flatnonzero(row[back] >= 0)
                at, back = at[ask], back[ask]
            got = successors.find(base[back] + value[at])
            # a value past the end of its context belongs to the next one
            ok = np.flatnonzero((got >= first[back]) & (got < last[back]))
            weight[at] = _DECODED[tail[successors.n + row]][back]
            hit, got = at[ok], got[ok]
            node[hit] = got + self.starts[s]
            p[hit] = _DECODED[tail[got]]
        if len(self.wide):
            place = np.minimum(np.searchsorted(self.wide, context), len(self.wide) - 1)
            spread = self.wide[place] == context
            weight[spread] = self.weights[place[spread]]
        return node, p, weight

    def opened(self, s: int):
        """(contexts, pointers, successors, codes) of a shard's file."""
        uri = f"{self.folder}/level-{self.order}-{s}"
        if uri not in _opened:
            if len(_opened) >= MOST_OPEN:
                _opened.clear()
            words = mapped(uri)
            contexts = Sequence(words)
            pointers = Sequence(words[contexts.end :])
            successors = Sequence(words[contexts.end + pointers.end :])
            _opened[uri] = contexts, pointers, successors, words[contexts.end + pointers.end + successors.end :].view(np.uint16)
        return _opened[uri]


#: Sequences of files that this process has open, MOST_OPEN at a time.
MOST_OPEN = 4096
_opened: dict[str, tuple] = {}


def route(context: np.ndarray, word: np.ndarray, size: int, shards: int, wide: np.ndarray, below: Level | None = None) -> np.ndarray:
    """Shard of each pair: by context (the shard where a longer one stands), or by pair where the context is wide."""
    shard = below.home(context) if below is not None and len(context) else (mixed(context.astype(np.uint64) + np.uint64(1)) % np.uint64(shards)).astype(np.int64)
    if len(wide):
        place = np.minimum(np.searchsorted(wide, context), len(wide) - 1)
        with np.errstate(over="ignore"):
            spread = (mixed(mixed(context.astype(np.uint64) * np.uint64(size) + word.astype(np.uint64)) + np.uint64(1)) % np.uint64(shards)).astype(np.int64)
        shard = np.where(wide[place] == context, spread, shard)
    return shard


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the words of each text and of one end after them."""
    low = lowered(raw)
    start, end, row = words_in(low, offsets)
    n = len(offsets) - 1
    h = ranges_hashed(prefix_sums(low), start, end)
    out, rows = np.full(len(h) + n, END), np.empty(len(h) + n, np.int64)
    word = np.arange(len(h)) + row  # an end stands after the words of every text before
    end = np.searchsorted(row, np.arange(n), side="right") + np.arange(n)
    out[word], rows[word], rows[end] = h, row, np.arange(n)
    return out, rows


def _folded(x: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, in order; how often)."""
    order = None if counts is None else np.argsort(x)
    x = np.sort(x) if order is None else x[order]
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    n = np.diff(np.r_[first, len(x)]) if order is None else np.add.reduceat(counts[order], first) if len(x) else np.zeros(0, np.int64)
    return x[first], n


def _folded_pairs(prefix: np.ndarray, last: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, last, how often) of distinct pairs, in order; as one number where both fit into 64 bits."""
    size = int(last.max()) + 1 if len(last) else 1
    if len(prefix) and int(prefix.max()) < (1 << 64) // size - 1:
        key, n = _folded(prefix * np.uint64(size) + last, counts)
        return key // np.uint64(size), key % np.uint64(size), n
    order = np.lexsort((last, prefix))
    prefix, last = prefix[order], last[order]
    first = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (last[1:] != last[:-1])]) if len(prefix) else np.zeros(0, np.int64)
    n = np.diff(np.r_[first, len(prefix)]) if counts is None else np.add.reduceat(counts[order], first) if len(prefix) else np.zeros(0, np.int64)
    return prefix[first], last[first], n


def _planes(x: np.ndarray, dtype) -> bytes:
    """An array byte plane by byte plane."""
    x = np.ascontiguousarray(x.astype(dtype))
    return x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def _unplanes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _blob(x: np.ndarray, dtype) -> bytes:
    """Differences of a sorted array, byte plane by byte plane, which the shuffle's compression shortens well."""
    x = x.astype(dtype)
    return _planes(np.diff(x, prepend=x.dtype.type(0)), dtype)


def _unblob(data: bytes, dtype) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(_unplanes(data, dtype), dtype=dtype)


def _dealt(shard: np.ndarray, keys: np.ndarray, last: np.ndarray, counts: np.ndarray):
    """Rows (shard, keys, last, counts) of sorted keys, one for each shard that has any."""
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0, True]) if len(shard) else np.zeros(1, np.int64)
    out: list[list] = [[], [], [], []]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        at = order[a:b]
        out[0].append(int(shard[at[0]]))
        out[1].append(_blob(keys[at], np.uint64))
        out[2].append(_planes(last[at], np.uint64))
        out[3].append(_planes(counts[at], np.uint32))
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["shard", "keys", "last", "counts"])


def _counted_words(batches, bits):
    for batch in trimmed(batches):
        raw, offsets = buffer_of(batch.column(0))
        for a, b in slices(offsets, SLICE):
            h, _ = tokens(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            keys, n = _folded(h)
            yield _dealt(Vocabulary("", bits, np.zeros(0)).shard_of(keys), keys, np.zeros(len(keys), np.uint64), n)


def _merged(batches):
    """(shard, keys, last, counts) of rows sorted by shard; partial sums are folded as they come."""
    shard, parts, size = None, [], 0

    def fold():
        return _folded_pairs(*(np.concatenate([p[i] for p in parts]) for i in range(3)))

    for batch in trimmed(batches):
        for s, keys, last, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
            if s != shard and parts:
                yield shard, *fold()
                parts, size = [], 0
            shard = s
            parts.append((_unblob(keys.as_py(), np.uint64), _unplanes(last.as_py(), np.uint64), _unplanes(counts.as_py(), np.uint32).astype(np.int64)))
            size += len(parts[-1][0])
            if size > 1_000_000 and len(parts) > 1:
                parts = [fold()]
                size = 0
    if parts:
        yield shard, *fold()


def _vocabulary(batches, folder, limit):
    for shard, keys, _, counts in _merged(batches):
        save(f"{folder}/level-1-{shard}", np.concatenate([packed(keys >> np.uint64(1)), counts.view(np.uint64)]))
        wide = np.flatnonzero((counts > limit) & (keys != END))
        end = np.flatnonzero(keys == END)
        yield _file(shard, counts, wide, [], [], [], [int(x) for x in end])


def _file(shard, counts, wide, names, spread, kinds, end=()):
    lists = ([int(x) for x in x] for x in (wide, counts[wide], names, spread, kinds, end))
    return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([len(counts)]), pa.array([int(counts.sum())]), *(pa.array([x], pa.list_(pa.int64())) for x in lists)], names=["shard", "n", "total", "wide", "wide_counts", "names", "spread", "kinds", "end"])


class Model:
    """What a worker needs to find n-grams; small, whatever the corpus."""

    def __init__(self, folder, bits, starts, total, distinct):
        self.vocabulary, self.total, self.distinct, self.levels = Vocabulary(folder, bits, starts), total, distinct, []

    def walked(self, raw: np.ndarray, offsets: np.ndarray, top: int, only_context: bool = False):
        """Per token: (row, id, count, node of the (top-1)-gram that ends before it or -1, P by levels up to top).

        only_context: stop before level top is asked; otherwise there is no node.
        """
        h, row = tokens(raw, offsets)
        own, back = np.unique(h, return_inverse=True)
        ids, counts = self.vocabulary.find(own)
        word, count = ids[back], counts[back]
        n, v = max(self.total, 1), self.distinct
        p = np.maximum(count - DISCOUNT, 0) / n + (DISCOUNT * v / n if self.total else 1.0) / (v + 1)
        node = word
        for k in range(2, top + 1):
            context = np.full(len(node), -1, np.int64)
            context[1:] = np.where(row[1:] == row[:-1], node[:-1], -1)
            if k == top and only_context:
                return row, word, count, context, p
            level, ask = self.levels[k - 2], np.flatnonzero(context >= 0)
            got, a, weight = self.asked(level, context[ask], word[ask])
            p[ask] = a + weight * p[ask]
            node = np.full(len(node), -1, np.int64)
            node[ask] = got
        return row, word, count, None, p

    def asked(self, level, context, word):
        """Level.find of each distinct pair; an unknown word has no node, but its context has a weight."""
        size = np.uint64(self.distinct + 1)
        own, back = np.unique(context.astype(np.uint64) * size + (word + 1).astype(np.uint64), return_inverse=True)
        first = own // size
        w = (own - first * size).astype(np.int64) - 1
        node, p, weight = level.find(first.astype(np.int64), np.where(w >= 0, w, self.distinct))
        return node[back], p[back], weight[back]


def _counted_grams(batches, model, order, shards, wide):
    """Rows of k-grams: of pairs (both words as one key), of longer ones (context and word before the last; last word).

    wide: counts of wide contexts by node, and their nodes by (context, word) key.
    """
    counts, names = wide
    size, full = np.uint64(model.distinct + 1), np.array(sorted(counts), np.int64)
    wide_keys = np.array(sorted(names), np.uint64)
    wide_nodes = np.array([names[k] for k in sorted(names)], np.int64)
    for batch in trimmed(batches):
        raw, offsets = buffer_of(batch.column(0))
        for a, b in slices(offsets, SLICE):
            row, word, _, context, _ = model.walked(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], max(2, order - 1), True)
            ok = (context >= 0) & (word >= 0)
            key = context.astype(np.uint64) * size + word.astype(np.uint64)
            if order == 2:
                keys, n = _folded(key[ok])
                yield _dealt(route((keys // size).astype(np.int64), (keys % size).astype(np.int64), int(size), shards, full), keys, np.zeros(len(keys), np.uint64), n)
                continue
            ok = np.flatnonzero(ok[:-1] & (word[1:] >= 0) & (row[1:] == row[:-1]))
            keys, last, n = _folded_pairs(key[ok], word[ok + 1].astype(np.uint64))
            below = model.levels[-1]
            # every pair stands where its first part sends it, so its shard is known without a look at the level
            shard = route((keys // size).astype(np.int64), (keys % size).astype(np.int64), int(size), shards, below.wide, below.below)
            if len(wide_keys):
                place = np.minimum(np.searchsorted(wide_keys, keys), len(wide_keys) - 1)
                spread = np.flatnonzero(wide_keys[place] == keys)
                shard[spread] = route(wide_nodes[place[spread]], last[spread].astype(np.int64), int(size), shards, full)
            yield _dealt(shard, keys, last, n)


def _level(batches, folder, model, order, wide, limit, end, final):
    size = model.distinct + 1
    full = np.array(sorted(wide), np.int64)
    full_counts = np.array([wide[w] for w in full.tolist()], np.int64)
    for shard, keys, last, counts in _merged(batches):
        if order == 2:
            context, word = keys // np.uint64(size), keys % np.uint64(size)
        else:
            edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            own, often = keys[edge], np.diff(np.r_[edge, len(keys)])
            node = np.empty(len(own), np.uint64)
            for a in range(0, len(own), ASKED):
                some = own[a : a + ASKED]
                node[a : a + ASKED] = model.levels[-1].find((some // np.uint64(size)).astype(np.int64), (some % np.uint64(size)).astype(np.int64))[0].astype(np.uint64)
            context, word = np.repeat(node, often), last
            if (node[1:] < node[:-1]).any():  # only where wide contexts of other shards are among them
                at = np.lexsort((last, context))
                context, word, counts = context[at], last[at], counts[at]
            del own, often, node, keys
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        own, kinds = context[first], np.diff(np.r_[first, len(context)])
        total = np.add.reduceat(counts, first)
        spread = np.zeros(len(own), bool)
        if len(full):
            place = np.minimum(np.searchsorted(full, own.astype(np.int64)), len(full) - 1)
            spread = full[place] == own.astype(np.int64)
            total = np.where(spread, full_counts[place], total)
        top = word[np.r_[first[1:], len(context)] - 1] + np.uint64(1)
        base = np.cumsum(top) - top
        values = np.repeat(base, kinds) + word + np.uint64(1)
        p = np.maximum(counts - DISCOUNT, 0) / np.repeat(total, kinds)
        codes = np.concatenate([quantised(p), quantised(DISCOUNT * kinds / total)])
        codes = np.concatenate([codes, np.zeros(-len(codes) % 4, np.uint16)])
        save(f"{folder}/level-{order}-{shard}", np.concatenate([packed(own), packed(np.r_[first, len(context)]), packed(values), codes.view(np.uint64)]))
        more = np.flatnonzero((counts > limit) & (word != np.uint64(end))) if not final else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            names = (context[more] * np.uint64(size) + word[more]).view(np.int64)
        yield _file(shard, counts, more, names, own[spread], kinds[spread])


def _scores(batches, model, order):
    for batch in trimmed(batches):
        raw, offsets = buffer_of(batch.column(2))
        out = [[], [], [], []]
        for a, b in slices(offsets, SCORED):
            row, word, count, _, p = model.walked(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], order)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[0].append(np.diff(np.r_[first, len(row)]))
            out[1].append(np.add.reduceat((count > 0).astype(np.int64), first))
            out[2].append(np.add.reduceat(np.log10((count + 1) / (model.total + model.distinct + 1)), first))
            out[3].append(np.add.reduceat(np.log10(np.maximum(p, 1e-300)), first))
        n, known, base, score = (np.concatenate(x) if x else np.zeros(0) for x in out)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model.total), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


_FILE = "shard long, n long, total long, wide array<long>, wide_counts array<long>, names array<long>, spread array<long>, kinds array<long>, end array<long>"


def _starts(rows, shards) -> tuple[np.ndarray, dict[int, int], dict[int, int]]:
    """(first id of each shard, or -1 if it is empty; counts of wide nodes; wide nodes by their key)."""
    starts, at, wide, names = np.full(shards, -1, np.int64), 0, {}, {}
    for r in sorted(rows):
        starts[r["shard"]] = at
        wide |= {at + i: c for i, c in zip(r["wide"], r["wide_counts"])}
        names |= {k % (1 << 64): at + i for i, k in zip(r["wide"], r["names"])}
        at += r["n"]
    return starts, wide, names


def trained(texts: DataFrame, order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> Model:
    """The model of a frame with the column text; nothing is pruned. The driver sees one row for each shard."""
    spark = texts.sparkSession
    texts = texts.select("text")
    size = int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    shards = max(1, -(-size // shard_bytes))
    bits = (max(1, shards // 4) - 1).bit_length()
    limit = size // 6 // (4 * shards) + LEAST_WIDE
    folder = fresh_path(spark, "lm")

    def built(sent, n, reducer, *args):
        dealt = sent.repartition(min(n, TASKS), F.col("shard")).sortWithinPartitions("shard")
        return dealt.mapInArrow(shipped(__name__, reducer, folder, *args), _FILE).collect()

    blobs = "shard long, keys binary, last binary, counts binary"
    rows = built(texts.mapInArrow(shipped(__name__, "_counted_words", bits), blobs), 1 << bits, "_vocabulary", limit)
    starts, wide, names = _starts(rows, 1 << bits)
    model = Model(folder, bits, starts, sum(r["total"] for r in rows), sum(r["n"] for r in rows))
    end = next((int(starts[r["shard"]]) + r["end"][0] for r in rows if r["end"]), model.distinct)
    for k in range(2, order + 1):
        rows = built(texts.mapInArrow(shipped(__name__, "_counted_grams", model, k, shards, (wide, names)), blobs), shards, "_level", model, k, wide, limit, end, k == order)
        kinds: dict[int, int] = {}
        for r in rows:
            for context, n in zip(r["spread"], r["kinds"]):
                kinds[context] = kinds.get(context, 0) + n
        starts, more, names = _starts(rows, shards)
        weights = {w: DISCOUNT * kinds.get(w, 0) / c if kinds.get(w) else 1.0 for w, c in wide.items()}
        model.levels.append(Level(folder, k, shards, model.distinct + 1, starts, wide, weights, model.levels[-1] if k > 2 else None))
        wide = more
    return model


def scored(docs: DataFrame, folds: int = 7, held: int = 2, order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows of fold `held` (crc32 of doc_id as text, modulo folds) don't train; a null doc_id trains. A null text is
    empty: its one token is the end. Repeated rows count each. With nothing to train on every word is unknown.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce(F.pmod(crc32_text(F.col("doc_id")), F.lit(folds)) == held, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    model = trained(rows.where("not held_out"), order, shard_bytes)
    return rows.mapInArrow(shipped(__name__, "_scores", model, order), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_lm_score(spark, sf_dir) -> DataFrame:
    """Query: all documents under the model of six sevenths of them."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
