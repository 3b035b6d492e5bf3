"""Repeated passages: longest-previous-factor lengths over suffix orders of the places that may repeat.

A text is looked at in two units: as bytes, of which a string of LENGTHS[0] is a repeat wherever else it starts, and as
words, of which a passage of LENGTHS[1] is shared if another document has it. Every such string has an anchor: the
k-gram of least hash inside it, the leftmost of equals. Equal strings have equal anchors at equal places, so only
strings of one anchor need comparing, and an anchor that occurs once has none. Consecutive strings of a text that
share an anchor are one segment, whose units are hashed as a whole: segments with equal hashes repeat entirely. (A
false copy needs the same anchor and an equal 64-bit hash: a chance of c**2 / 2**65 for an anchor of c segments.)
Where one anchor has different segments, one of each kind meets in a suffix order of the strings that may repeat;
previous and next smaller positions in that order give each string its longest previous factor, and where that reaches
the length, the string has an earlier match. Where an anchor has more than `crowd` kinds, its segments are first cut
into `WAYS` parts by the distance to the anchor, keyed by all units that a part's strings share, and so on until no
key is crowded: at a distance of one a key is a whole string, so this ends.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, buffer_of, cut, drop, joined_by, mixed, prefix_sums, ranges_hashed, shipped, texts_of, words_in

#: Strings and k-grams by unit: bytes, and words that stand for themselves as 32 bits of their hash.
BYTES, WORDS = 0, 1
LENGTHS, GRAMS, KINDS = (400, 51), (32, 8), (np.dtype(np.uint8), np.dtype("<u4"))
CROWD, WAYS, CHUNK, BATCH = 1024, 4, 1 << 21, 1 << 20
OTHER_BASE = 0xD1342543DE82EF95 | 1
#: Rounds of jumps after which what is still open goes by a stack.
ROUNDS = 24


def units_of(raw: np.ndarray, offsets: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """(units, offsets) of texts: the bytes, or a code for each run of bytes that are not ASCII whitespace."""
    if unit == BYTES:
        return raw, offsets
    start, end, row = words_in(raw, offsets)
    codes = (ranges_hashed(prefix_sums(raw), start, end) >> np.uint64(32)).astype(KINDS[WORDS])
    return codes, np.searchsorted(row, np.arange(len(offsets)))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values, by minima from block edges."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def segments(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(row, first start, last start, anchor hash, segment hash, distance of the first start to the anchor) of each segment."""
    parts = []
    for at in range(0, max(0, len(raw) - length + 1), CHUNK):
        piece = raw[at : at + CHUNK + length - 1]
        sums = prefix_sums(piece)
        where = np.arange(len(piece) - gram + 1)
        g = ranges_hashed(sums, where, where + gram)
        least = sliding_least(((g >> np.uint64(24)) << np.uint64(24)) | where.astype(np.uint64), length - gram + 1)
        anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        start = np.arange(len(anchor))
        row = np.searchsorted(offsets, start + at, side="right") - 1
        valid = start + at + length <= offsets[np.minimum(row + 1, len(offsets) - 1)]
        start, anchor, row = start[valid], anchor[valid], row[valid]
        if not len(start):
            continue
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
        last = np.r_[first[1:], len(start)] - 1
        s, e, a, r = start[first], start[last], anchor[first], row[first]
        with np.errstate(over="ignore"):
            kind = mixed(ranges_hashed(sums, s, e + length) ^ ((a - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        parts.append((r, s + at - offsets[r], e + at - offsets[r], g[a], kind, a - s))
    if not parts:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)]
    return [np.concatenate(x) for x in zip(*parts)]


def _slices_of(offsets: np.ndarray, most: int):
    """Runs of texts of about `most` bytes; a longer text stands alone."""
    edge, n = 0, len(offsets) - 1
    while edge < n:
        stop = min(n, max(edge + 1, int(np.searchsorted(offsets, offsets[edge] + most, side="right")) - 1))
        yield edge, stop
        edge = stop


def _segmented(batches, lengths, grams):
    """The lowest bit of an anchor is its unit. A document's equal segments of words are one row."""
    for batch in batches:
        raw, offsets = buffer_of(batch.column(2))
        for a, b in _slices_of(offsets, CHUNK):
            for unit in (BYTES, WORDS):
                values, edges = units_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], unit)
                row, s, e, anchor, kind, lead = segments(values, edges, lengths[unit], grams[unit])
                anchor = anchor & ~np.uint64(1) | np.uint64(unit)
                if unit == WORDS and len(row):
                    order = np.lexsort((kind, row))
                    first = np.r_[True, (row[order[1:]] != row[order[:-1]]) | (kind[order[1:]] != kind[order[:-1]])]
                    one = np.sort(order[first])
                    row, s, e, anchor, kind, lead = (x[one] for x in (row, s, e, anchor, kind, lead))
                at = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(kind.view(np.int64))], names=["doc_id", "t", "s", "e", "lead", "anchor", "kind"])


_PIECE = ["s", "e", "lead", "anchor", "n", "lo", "hi", "m"]


def _cut_out(batches, lengths):
    """One row for each segment of the list `segs`, with its units."""
    for batch in batches:
        texts = texts_of(batch.column(2))
        out: list[list] = [[] for _ in range(2 + len(_PIECE))]
        for i, segs in enumerate(batch.column(3).to_pylist()):
            units = {}
            for x in segs:
                unit = x["anchor"] & 1
                if unit not in units:
                    units[unit] = texts[i] if unit == BYTES else units_of(np.frombuffer(texts[i], np.uint8), np.array([0, len(texts[i])]), unit)[0].tobytes()
                size = KINDS[unit].itemsize
                for k, v in enumerate((i, *(x[c] for c in _PIECE), units[unit][size * x["s"] : size * (x["e"] + lengths[unit])])):
                    out[k].append(v)
            if len(out[0]) > 4096:
                yield _pieces(batch, out)
                out = [[] for _ in out]
        yield _pieces(batch, out)


def _pieces(batch, out):
    at = pa.array(out[0], pa.int64())
    return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x, pa.int64()) for x in out[1:-1]), pa.array(out[-1], pa.binary())], names=["doc_id", "t", *_PIECE, "bytes"])


def suffix_ranks(values: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(units, ranks of each position by so many units), by doubling, up to `length`; equal strings have equal ranks."""
    n = len(values)
    if values.dtype == np.uint8 and length >= 8:
        padded = np.r_[values, np.zeros(8, np.uint8)].astype(np.uint64)
        key, have = np.zeros(n, np.uint64), 8
        for k in range(8):
            key = (key << np.uint64(8)) | padded[k : k + n]
    else:
        key, have = values, 1
    levels = [(have, np.unique(key, return_inverse=True)[1].astype(np.int64))]
    while have < length:
        rank = levels[-1][1]
        step = min(have, length - have)
        ahead = np.full(n, -1, np.int64)
        ahead[: max(0, n - step)] = rank[step:]
        have += step
        levels.append((have, np.unique(rank * (n + 1) + ahead + 1, return_inverse=True)[1].astype(np.int64)))
    return levels


def smaller_before(x: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1.

    All places jump on at once, which ends after a few rounds where values are mixed; what a long rise before a fall leaves
    open is found by one pass with a stack, so the time is linear in any case.
    """
    at = np.arange(len(x)) - 1
    open_ = np.arange(len(x))
    for _ in range(ROUNDS):
        open_ = open_[(at[open_] >= 0) & (x[at[open_]] >= x[open_])]
        if not len(open_):
            return at
        at[open_] = at[at[open_]]
    stack: list[int] = []
    values, out = x.tolist(), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] >= v:
            stack.pop()
        out.append(stack[-1] if stack else -1)
        stack.append(i)
    return np.array(out, np.int64)


def common_prefix(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Units, in steps of the first level's and up to `length`, in which the strings at a and b agree."""
    n, out = len(levels[0][1]), np.zeros(len(a), np.int64)
    whole = levels[-1][1][a] == levels[-1][1][b]
    for have, rank in reversed(levels[:-1]):
        x, y = a + out, b + out
        ok = (x < n) & (y < n) & (out + have <= length)
        out[ok] += have * (rank[x[ok]] == rank[y[ok]])
    return np.where(whole, length, np.minimum(out, length - 1))


def longest_previous(levels: list[tuple[int, np.ndarray]], pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order of the positions pos, longest previous factor of each in that order), both up to `length` units.

    Of all earlier positions, the previous and the next smaller one in suffix order share the most with a position.
    """
    order = pos[np.lexsort((pos, levels[-1][1][pos]))]
    before, after = smaller_before(order), len(order) - 1 - smaller_before(order[::-1])[::-1]
    lpf = np.zeros(len(order), np.int64)
    for near in (before, after):
        held = np.flatnonzero((near >= 0) & (near < len(order)))
        lpf[held] = np.maximum(lpf[held], common_prefix(levels, order[held], order[near[held]], length))
    return order, lpf


def matches(pieces: list[np.ndarray], length: int, lo: np.ndarray, hi: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece, whether the string at each start has an earlier copy, a later one, and one in another document.

    lo and hi: least and greatest document that each piece stands for. Strings that differ from all others in a 64-bit
    hash cannot repeat and are left out before the suffix order is built.
    """
    sizes = np.array([len(p) for p in pieces])
    values = np.concatenate(pieces)
    ends = np.cumsum(sizes)
    counts = sizes - length + 1
    pos = np.arange(counts.sum()) + np.repeat(ends - sizes - (np.cumsum(counts) - counts), counts)
    piece = np.repeat(np.arange(len(sizes)), counts)
    _, which, often = np.unique(ranges_hashed(prefix_sums(values), pos, pos + length), return_inverse=True, return_counts=True)
    some = often[which] > 1
    before, after, apart = (np.zeros(len(pos), bool) for _ in range(3))
    if some.any():
        # what is left, piece by piece, with the units of its last strings
        covered = np.zeros(len(values) + 1, np.int64)
        np.add.at(covered, pos[some], 1)
        np.add.at(covered, pos[some] + length, -1)
        kept = np.cumsum(covered[:-1]) > 0
        place = np.cumsum(kept) - 1
        number = np.zeros(int(kept.sum()), np.int64)
        number[place[pos[some]]] = np.flatnonzero(some)
        levels = suffix_ranks(values[kept], length)
        order, lpf = longest_previous(levels, place[pos[some]], length)
        first = np.flatnonzero(lpf < length)  # a run: a string and its later copies
        size = np.diff(np.r_[first, len(order)])
        mine = number[order]
        least, most = np.minimum.reduceat(lo[piece[mine]], first), np.maximum.reduceat(hi[piece[mine]], first)
        before[mine] = lpf >= length
        after[mine] = np.r_[lpf[1:] >= length, False]
        apart[mine] = np.repeat(least != most, size)
    return [tuple(x[c - n : c] for x in (before, after, apart)) for c, n in zip(np.cumsum(counts).tolist(), counts.tolist())]


def _matched(batches, lengths, first_stays):
    """Rows sorted by anchor and order of texts. Whole anchors go together until a batch is full."""
    held: list[tuple] = []
    size = 0

    def done():
        rows = []
        for unit in (BYTES, WORDS):
            own = [h for h in held if h[4] & 1 == unit]
            if not own:
                continue
            found = matches([np.frombuffer(h[7], KINDS[unit]) for h in own], lengths[unit], np.array([h[5] for h in own]), np.array([h[6] for h in own]))
            for (doc, t, s, n, anchor, lo, hi, _), (before, after, apart) in zip(own, found):
                if unit == BYTES and n > 1 and not first_stays or unit == WORDS and lo != hi:  # decided by equal hashes
                    continue
                hit = apart if unit == WORDS else before if first_stays else before | after
                edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
                rows += [(doc, t, unit, s + a, s + b - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
        cols = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(cols[0], held_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "t", "unit", "s", "e"])

    held_type = pa.int64()
    for batch in batches:
        held_type = batch.schema.field("doc_id").type
        data = batch.select(["doc_id", "t", "s", "n", "anchor", "lo", "hi", "bytes"]).to_pydict()
        for row in zip(*data.values()):
            if size > BATCH and row[4] != held[-1][4]:
                yield done()
                held, size = [], 0
            held.append(row)
            size += len(row[7])
    if held:
        yield done()


def _finer(batches, lengths, widths):
    """Pieces cut by the distance from a start to the anchor, `width` distances each.

    All strings of one part hold the same units around the anchor, and their hash is the new key: equal strings stand
    at equal distances, so they still meet, and longer surroundings tell more pieces apart than the anchor did.
    """
    for batch in batches:
        column = {c: batch.column(batch.schema.get_field_index(c)) for c in ("s", "e", "lead", "anchor", "n", "lo", "hi", "bytes")}
        first_, last_, lead_, old = (column[c].to_numpy(zero_copy_only=False) for c in ("s", "e", "lead", "anchor"))
        raw, offsets_ = buffer_of(column["bytes"])
        for unit in (BYTES, WORDS):
            mine = np.flatnonzero((old & 1) == unit)
            length, width, size = lengths[unit], widths[unit], KINDS[unit].itemsize
            for at_ in range(0, len(mine), 2048):
                own = mine[at_ : at_ + 2048]
                data_ = [raw[offsets_[i] : offsets_[i + 1]] for i in own.tolist()]
                piece = np.concatenate(data_).view(KINDS[unit])
                off = np.cumsum([0, *(len(x) // size for x in data_)])[:-1]
                first, last, lead = first_[own], last_[own], lead_[own]
                far, near = lead // width, (lead - (last - first)) // width
                counts = far - near + 1
                row = np.repeat(np.arange(len(own)), counts)
                cell = far[row] - np.arange(len(row)) + np.repeat(np.cumsum(counts) - counts, counts)
                anchor, least = lead[row], cell * width
                s = np.maximum(0, anchor - least - width + 1)
                e = np.minimum((last - first)[row], anchor - least)
                sums, at = prefix_sums(piece), off[row]
                with np.errstate(over="ignore"):
                    key = mixed(ranges_hashed(sums, at + anchor - least, at + anchor - least - width + 1 + length) + cell.astype(np.uint64) * np.uint64(OTHER_BASE))
                    kind = mixed(ranges_hashed(sums, at + s, at + e + length) ^ ((anchor - s).astype(np.uint64) * np.uint64(BASE)))
                key = key & ~np.uint64(1) | np.uint64(unit)
                view, take = piece.tobytes(), pa.array(own[row])
                data = [view[size * i : size * j] for i, j in zip((at + s).tolist(), (at + e + length).tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(first[row] + s), pa.array(first[row] + e), pa.array(anchor - s), pa.array(key.view(np.int64)), pa.array(kind.view(np.int64)), *(column[c].take(take) for c in ("n", "lo", "hi")), pa.array(data, pa.binary())], names=["doc_id", "t", "s", "e", "lead", "anchor", "kind", "n", "lo", "hi", "bytes"])


def _same_place(place: str):
    return F.col("doc_id").eqNullSafe(F.col(f"{place}.doc_id")) & (F.col("t") == F.col(f"{place}.t")) & (F.col("s") == F.col(f"{place}.s"))


def _unit():
    return F.col("anchor").bitwiseAND(F.lit(1).cast("long"))


def _decided(count: str, lo: str = "lo", hi: str = "hi"):
    """Whether equal hashes alone show that a segment repeats: bytes by a second place, words by a second document."""
    return F.when(_unit() == BYTES, F.col(count) > 1).otherwise(F.col(lo) != F.col(hi))


def _refined(pieces: DataFrame, kind: str, lengths, widths, first_stays: bool) -> tuple[DataFrame, DataFrame]:
    """(starts decided by equal hashes of whole parts, one part of each kind where a finer key has several)."""
    long = lambda names: ", ".join(f"{c} long" for c in names)
    parts = cut(pieces.mapInArrow(shipped(__name__, "_finer", lengths, widths), f"doc_id {kind}, {long(['t', 's', 'e', 'lead', 'anchor', 'kind', 'n', 'lo', 'hi'])}, bytes binary"), "repeat-parts")
    kinds = cut(parts.groupBy("anchor", "kind").agg(F.count("*").alias("parts"), F.sum("n").alias("all"), F.min("lo").alias("_lo"), F.max("hi").alias("_hi"), F.min(F.struct("doc_id", "t", "s")).alias("rep")), "repeat-part-kinds")
    info = kinds.join(kinds.groupBy("anchor").agg(F.count("*").alias("m")), "anchor").where("parts > 1 or m > 1")
    ahead = (F.col("m") > 1) & _same_place("rep")
    decided = F.when(_unit() == BYTES, F.col("parts") > 1).otherwise((F.col("lo") == F.col("hi")) & (F.col("_lo") != F.col("_hi")))
    if first_stays:
        decided = decided & ((_unit() == WORDS) | ~_same_place("rep"))
    marked = cut(joined_by(parts, info, ["anchor", "kind"], "parts", parts.count()).select("doc_id", "t", "s", "e", "lead", "anchor", F.col("all").alias("n"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), "m", F.when(ahead, F.col("bytes")).alias("bytes"), decided.alias("hit")), "repeat-marked")
    return marked.where("hit").select("doc_id", "t", _unit().alias("unit"), "s", "e"), marked.where("bytes is not null").drop("hit")


def _runs(starts, length):
    """(covered runs) of starts (s, e): strings of `length` units that overlap or touch are one."""
    out: list[list[int]] = []
    for x in sorted(starts, key=lambda x: x["s"]):
        if out and x["s"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["e"] + length)
        else:
            out.append([x["s"], x["e"] + length])
    return out


def _shared_words(text: bytes, starts, length: int) -> int:
    """Words in passages whose hash is that of a passage which starts at `starts`: the text's own copies count too."""
    codes, _ = units_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]), WORDS)
    where = np.arange(len(codes) - length + 1)
    h = ranges_hashed(prefix_sums(codes), where, where + length)
    hit = np.isin(h, h[np.unique(np.concatenate([np.arange(x["s"], x["e"] + 1) for x in starts]))])
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, where[hit], 1)
    np.add.at(edge, where[hit] + length, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _kept(batches, lengths):
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for text, starts in zip(texts_of(batch.column(1)), batch.column(2).to_pylist()):
            gone = _runs([x for x in starts or [] if x["unit"] == BYTES], lengths[BYTES])
            words = [x for x in starts or [] if x["unit"] == WORDS]
            data = b"".join(text[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(text)]))
            for k, v in enumerate((len(text), sum(e - s for s, e in gone), len(gone), hashlib.sha256(data).hexdigest(), _shared_words(text, words, lengths[WORDS]) if words else 0, data)):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[k], pa.int64()) for k in range(3)), pa.array(out[3], pa.string()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words", "kept"])


def repeated(docs: DataFrame, length: int = LENGTHS[BYTES], gram: int = GRAMS[BYTES], keep: str = "none", crowd: int = CROWD, passage: int = LENGTHS[WORDS], word_gram: int = GRAMS[WORDS]) -> DataFrame:
    """(doc_id, t, unit, s, e): byte or word positions s to e at which a repeated string of that unit's length starts.

    t is the hash of the text. keep="first" leaves out the first copy of strings of bytes, by doc_id and position;
    keep="none" has all. Strings of words count if another document has them; rows that repeat both doc_id and text are
    one document there, and at least one place of each of a document's strings is given.
    """
    kind, lengths, grams = dict(docs.dtypes)["doc_id"], (length, passage), (gram, word_gram)
    least = min(length, 2 * passage - 1)
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), "text").where(F.octet_length("text") >= least)
    found = cut(rows.mapInArrow(shipped(__name__, "_segmented", lengths, grams), f"doc_id {kind}, t long, s int, e int, lead int, anchor long, kind long"), "repeat-segments")
    often = found.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1")
    shared = cut(joined_by(found, often, ["anchor"], "c", found.count()).drop("c"), "repeat-shared")
    drop(found)
    who = F.xxhash64("doc_id", "t")
    kinds = cut(shared.groupBy("anchor", "kind").agg(F.count("*").alias("n"), F.min(who).alias("lo"), F.max(who).alias("hi"), F.min(F.struct("doc_id", "t", "s", "e", "lead")).alias("rep")), "repeat-kinds")
    several = kinds.groupBy("anchor").agg(F.count("*").alias("m"), F.min("lo").alias("_lo"), F.max("hi").alias("_hi")).where((_unit() == BYTES) | (F.col("_lo") != F.col("_hi"))).where("m > 1").select("anchor", "m")
    whole = kinds.where(_decided("n"))
    copies = joined_by(shared, whole, ["anchor", "kind"], "n", shared.count())
    if keep == "first":
        copies = copies.where((_unit() == WORDS) | ~_same_place("rep"))
    mixed_ = kinds.join(several, "anchor").select("rep.*", "anchor", "n", "lo", "hi", "m")
    lists = mixed_.groupBy("doc_id", "t").agg(F.collect_list(F.struct(*_PIECE)).alias("segs"))
    joined = rows.join(lists.select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), "segs"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t"))).select("doc_id", "t", "text", "segs")
    long = ", ".join(f"{c} long" for c in ("t", *_PIECE))
    pieces = cut(joined.mapInArrow(shipped(__name__, "_cut_out", lengths), f"doc_id {kind}, {long}, bytes binary").dropDuplicates(["doc_id", "t", "s", "anchor"]), "repeat-pieces")
    first_stays, widths = keep == "first", [n - g + 1 for n, g in zip(lengths, grams)]
    found_, calm, dense = [copies.select("doc_id", "t", _unit().alias("unit"), F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))], [pieces.where(F.col("m") <= crowd)], pieces.where(F.col("m") > crowd)
    while not dense.isEmpty():
        widths = [max(1, -(-w // WAYS)) for w in widths]
        decided, open_ = _refined(dense, kind, lengths, widths, first_stays)
        found_.append(decided)
        calm.append(open_.where(F.col("m") <= crowd))
        dense = open_.where(F.col("m") > crowd)
    dealt = reduce(DataFrame.unionByName, calm).repartition("anchor").sortWithinPartitions("anchor", "doc_id", "t", "s")
    ordered = dealt.mapInArrow(shipped(__name__, "_matched", lengths, first_stays), f"doc_id {kind}, t long, unit long, s long, e long")
    return reduce(DataFrame.union, [*found_, ordered])


def removed(docs: DataFrame, length: int = LENGTHS[BYTES], gram: int = GRAMS[BYTES], keep: str = "none", crowd: int = CROWD, passage: int = LENGTHS[WORDS], word_gram: int = GRAMS[WORDS]) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words, kept (bytes).

    Bytes covered by a repeated string go; positions are judged on the input. n_shared_words counts the words in
    passages of `passage` words that another document has as well; it removes nothing. A null text is empty. Rows that
    repeat both doc_id and text count as copies of each other for bytes, where keep="first" cannot tell them apart, and
    as one document for words. No rows, no result.
    """
    kind = dict(docs.dtypes)["doc_id"]
    starts = repeated(docs, length, gram, keep, crowd, passage, word_gram).distinct().groupBy("doc_id", "t").agg(F.collect_list(F.struct("unit", "s", "e")).alias("starts")).select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), "starts")
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    joined = text.join(starts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")), "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(shipped(__name__, "_kept", (length, passage)), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long, kept binary")


def op9_repeats(spark, sf_dir) -> DataFrame:
    """Query: every byte of all documents that a repeated string of 400 bytes covers goes, first copies too."""
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
