"""Tokens with their places: tokenizers by contract, offsets, chunks and span views, all within the row of a text.

A tokenizer is a callable with a `name`; it takes a list of texts and gives, for each, (ids, offsets), offsets being
(start, end) pairs in characters. Texts go through it by Arrow batch, whatever follows stays in the row's partition:
no text is shuffled, sorted or joined to itself, and rows that repeat an id stay apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ship import given_back, shipped

Encoded = tuple[Sequence[int], Sequence[tuple[int, int]]]
Tokenizer = Callable[[list[str]], list[Encoded]]
#: Code points of white space, as regular expressions over Unicode text have it.
SPACES = np.array([*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
#: Bytes of text that are looked at together.
BLOCK = 1 << 20
#: Columns of chunks().
CHUNK = ["chunk_no", "tok_start", "tok_end", "char_start", "char_end", "text", "chunk_id", "chunker_hash"]


class Whitespace:
    """Runs of characters that are not white space; the id is the big-endian 32-bit BLAKE2b digest of the token."""

    name = "whitespace"

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of each token of all texts."""
        sizes = np.array([len(t) for t in texts], np.int64)
        edges = np.cumsum(sizes) - sizes
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        word = np.ones(len(points) + 2, bool)
        word[[0, -1]] = False
        low = points <= 0x20
        word[1:-1] = ~np.where(low, np.isin(np.arange(0x21), SPACES)[np.minimum(points, 0x20)], (points > 0x7F) & np.isin(points, SPACES))
        inner = np.zeros(len(word), bool)
        inner[1 + edges[sizes > 0]] = True  # a token never runs on into the next text
        start = np.flatnonzero(word[1:-1] & (~word[:-2] | inner[1:-1]))
        end = np.flatnonzero(word[1:-1] & (~word[2:] | np.r_[inner[2:-1], True])) + 1
        row = np.searchsorted(edges, start, side="right") - 1
        return row, start - edges[row], end - edges[row]

    def __call__(self, texts: list[str]) -> list[Encoded]:
        row, start, end = self.places(texts)
        out: list[tuple[list[int], list[tuple[int, int]]]] = [([], []) for _ in texts]
        for i, s, e in zip(row.tolist(), start.tolist(), end.tolist()):
            out[i][0].append(token_id(texts[i][s:e]))
            out[i][1].append((s, e))
        return out


def token_id(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=4).digest(), "big")


def _encoded(tokenizer: Tokenizer, texts: list[str]) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
    """(text, [(index, id, start, end)]) of tokens with a width; the index counts those without one as well."""
    for i, (ids, offsets) in enumerate(tokenizer(texts)):
        if offsets is None:
            raise ValueError("a tokenizer must give offsets")
        if len(ids) == 1 and isinstance(ids[0], (list, tuple)):  # a batch of one
            ids = ids[0]
        if len(offsets) == 1 and len(offsets[0]) and isinstance(offsets[0][0], (list, tuple)):
            offsets = offsets[0]
        if len(ids) != len(offsets):
            raise ValueError("ids and offsets differ in number")
        yield i, [(k, int(t), int(s), int(e)) for k, (t, (s, e)) in enumerate(zip(ids, offsets)) if int(e) > int(s)]


def _flat(tokenizer: Tokenizer | None, texts: list[str], ids: bool):
    """(text, index, id or None, start, end) of all tokens as arrays."""
    if isinstance(tokenizer, Whitespace):
        row, start, end = tokenizer.places(texts)
        index = np.arange(len(row)) - np.searchsorted(row, row)
        return row, index, [token_id(texts[i][s:e]) for i, s, e in zip(row.tolist(), start.tolist(), end.tolist())] if ids else None, start, end
    flat = [(i, *token) for i, tokens in _encoded(tokenizer, texts) for token in tokens]
    cols = np.array(flat, np.int64).reshape(-1, 5).T
    return cols[0], cols[1], cols[2].tolist() if ids else None, cols[3], cols[4]


def _texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def _blocks(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about BLOCK bytes of text, or one longer text; only such a range becomes Python strings."""
    first, size = 0, 0
    for i, n in enumerate(pc.binary_length(column).to_pylist()):
        size += n or 0
        if size >= BLOCK or i == len(column) - 1:
            yield first, i + 1
            first, size = i + 1, 0


def _mapped(docs: DataFrame, by: str, text: str, schema: str, rows: str, *args, more: Sequence[str] = ()) -> DataFrame:
    """The named function gives (text numbers, columns) for a block of texts and of the columns `more`; `by` goes along."""
    names = [by, *(c.split()[0] for c in schema.split(", "))]
    return docs.select(by, text, *more).mapInArrow(shipped(__name__, "_run", rows, names, args), f"{by} {dict(docs.dtypes)[by]}, {schema}")


def _run(batches, rows, names, args):
    for batch in batches:
        for a, b in _blocks(batch.column(1)):
            given = [c.slice(a, b - a).to_pylist() for c in batch.columns[2:]]
            row, columns = globals()[rows](_texts(batch.column(1).slice(a, b - a)), given, *args)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + a)), *columns], names=names)
            del given, row, columns
        del batch  # before the next one is read
        given_back()


def _offset_rows(texts, _, tokenizer, ids):
    row, index, found, start, end = _flat(tokenizer or Whitespace(), texts, ids)
    words = [texts[i][s:e] for i, s, e in zip(row.tolist(), start.tolist(), end.tolist())]
    return row, [pa.array(index, pa.int32()), pa.array(words, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), *([pa.array(found, pa.int64())] if ids else [])]


def token_offsets(docs: DataFrame, by: str = "doc_id", text: str = "text", tokenizer: Tokenizer | None = None, ids: bool = False) -> DataFrame:
    """(by, token_index, token, char_start, char_end[, token_id]) of each token with a width; none of a null text."""
    return _mapped(docs, by, text, "token_index int, token string, char_start int, char_end int" + ", token_id long" * ids, "_offset_rows", tokenizer, ids)


def window_starts(n: int, size: int, overlap: int) -> range:
    """Starts of windows over n tokens; the first window that reaches the end is the last one."""
    return range(0, max(n - overlap, 1) if n else 0, size - overlap)


def _by_text(texts, tokenizer):
    """(text, starts, ends) of each text that has tokens."""
    row, _, _, start, end = _flat(tokenizer or Whitespace(), texts, False)
    edges = np.searchsorted(row, np.arange(len(texts) + 1))
    for i in np.flatnonzero(np.diff(edges)).tolist():
        yield i, start[edges[i] : edges[i + 1]].tolist(), end[edges[i] : edges[i + 1]].tolist()


def _chunk_rows(texts, given, tokenizer, size, overlap):
    out = []
    for i, start, end in _by_text(texts, tokenizer):
        for no, s in enumerate(window_starts(len(start), size, overlap)):
            e = min(s + size, len(start))
            a, b = start[s], end[e - 1]
            cut = [[(max(r["start"], a), min(r["end"], b)) for r in g[i] or [] if min(r["end"], b) > max(r["start"], a)] for g in given]
            both = [[{"start": p - at, "end": q - at} for p, q in c] for c in cut for at in (0, a)]
            out.append((i, no, s, e, a, b, texts[i][a:b], *both))
    cols = list(zip(*out)) or [()] * (7 + 2 * len(given))
    pairs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = [*[pa.int32()] * 5, pa.string(), *[pairs] * (2 * len(given))]
    return np.array(cols[0], np.int64), [pa.array(c, k) for c, k in zip(cols[1:], kinds)]


def chunks(docs: DataFrame, size: int = 256, overlap: int = 32, tokenizer: Tokenizer | None = None, by: str = "doc_id", text: str = "text", ranges: Sequence[str] = (), key: Column | None = None) -> DataFrame:
    """(by, chunk_no, tok_start, tok_end, char_start, char_end, text, chunk_id, chunker_hash[, r_source, r_chunk ...]).

    Windows of `size` tokens that share `overlap` tokens; none of an empty or null text. ranges: array columns of
    (start, end) in the text; each comes back cut to the chunk, in places of the text (r_source) and of the chunk
    (r_chunk), without those that do not reach into it. key: the id that chunk ids are made of, `by` unless given.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive, overlap at least 0 and below size")
    name, spans = str(getattr(tokenizer or Whitespace(), "name", type(tokenizer).__name__)), "array<struct<start:int,end:int>>"
    schema = "chunk_no int, tok_start int, tok_end int, char_start int, char_end int, text string" + "".join(f", {r}_source {spans}, {r}_chunk {spans}" for r in ranges)
    made = _mapped(docs, by, text, schema, "_chunk_rows", tokenizer, size, overlap, more=ranges)
    config = F.sha2(F.lit(f'{{"chunk_size": {size}, "overlap": {overlap}, "tokenizer": "{name}"}}'), 256)
    made = made.withColumn("chunker_hash", config)
    return made.withColumn("chunk_id", F.substring(F.sha2(F.concat_ws(":", (F.col(by) if key is None else key).cast("string"), "tok_start", "tok_end", "chunker_hash"), 256), 1, 24))


def _span_rows(texts, _, tokenizer, size, offsets):
    out = []
    for i, start, end in _by_text(texts, tokenizer):
        for v in offsets:
            for s in range(v, len(start), size):
                e = min(s + size, len(start))
                out.append((i, v, s, e, start[s], end[e - 1], texts[i][start[s] : end[e - 1]]))
    cols = list(zip(*out)) or [()] * 7
    return np.array(cols[0], np.int64), [*(pa.array(c, pa.int32()) for c in cols[1:6]), pa.array(cols[6], pa.string())]


def spans(texts: DataFrame, *keys: str, size: int = 32, offsets: Sequence[int] = (0, 16), tokenizer: Tokenizer | None = None, text: str = "text") -> DataFrame:
    """(keys, view, tok_start, tok_end, start, end, span): windows of `size` tokens of each view that starts inside a text.

    start and end are places in the text, span is what stands there. The last window of a view may be shorter.
    """
    held = texts.select(F.struct(*keys).alias("_k"), F.col(text).alias("_t"))
    schema = "view int, tok_start int, tok_end int, start int, end int, span string"
    return _mapped(held, "_k", "_t", schema, "_span_rows", tokenizer, size, tuple(offsets)).select("_k.*", "view", "tok_start", "tok_end", "start", "end", "span")


def _chunk_span_rows(texts, _, tokenizer, size, overlap, span, offsets, lengths):
    row, _, _, start, end = _flat(tokenizer or Whitespace(), texts, False)
    sums = [np.r_[0, np.cumsum(end - start <= k)] for k in lengths]
    edges = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
    out = []
    for i, (base, upto) in enumerate(zip(edges, edges[1:])):
        for no, s in enumerate(window_starts(upto - base, size, overlap)):
            e = min(s + size, upto - base)
            out += [(i, no, v, a - s, min(a + span, e) - s, base + a, base + min(a + span, e)) for v in offsets for a in range(s + v, e, span)]
    cols = np.array(out, np.int64).reshape(-1, 7).T
    first, last = cols[5], cols[6]
    counts = [x[last] - x[first] for x in sums]
    return cols[0], [pa.array(c, pa.int32()) for c in (*cols[1:5], start[first], end[last - 1], last - first, *counts)]


def chunk_spans(docs: DataFrame, size: int = 256, overlap: int = 32, span: int = 32, offsets: Sequence[int] = (0, 16), lengths: Sequence[int] = (), tokenizer: Tokenizer | None = None, by: str = "doc_id", text: str = "text") -> DataFrame:
    """(by, chunk_no, view, tok_start, tok_end, start, end, n, n_upto_K ...): spans() of chunks() in one pass, without texts.

    Tokens count from the chunk's first, start and end are places in the text of the document. n: tokens of the span,
    n_upto_K: those of K characters at most, for each K of `lengths`.
    """
    schema = "chunk_no int, view int, tok_start int, tok_end int, start int, end int, n int" + "".join(f", n_upto_{k} int" for k in lengths)
    return _mapped(docs, by, text, schema, "_chunk_span_rows", tokenizer, size, overlap, span, tuple(offsets), tuple(lengths))


def _token_lists(column: pa.Array, tokenizer, ids: bool = True) -> pa.Array:
    """The tokens of each text as arrays of numbers, 20 bytes a token; a block of texts is taken apart at a time."""
    kind = pa.list_(pa.struct([("id", pa.int64())] * ids + [("index", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    parts = [pa.array([], kind)]
    for a, b in _blocks(column):
        texts = _texts(column.slice(a, b - a))
        row, index, found, start, end = _flat(tokenizer or Whitespace(), texts, ids)
        edges = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)), pa.int32())
        places = [*([pa.array(found, pa.int64())] if ids else []), *(pa.array(c, pa.int32()) for c in (index, start, end))]
        parts.append(pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays(places, fields=list(kind.value_type)), type=kind))
        del texts, row, index, found, start, end, edges, places
    lists = pa.concat_arrays(parts)
    del parts
    given_back()
    return lists


def with_tokens(df: DataFrame, text: str = "text", tokenizer: Tokenizer | None = None, name: str = "tokens", ids: bool = True) -> DataFrame:
    """df with an array column of ([id, ]index, start, end) for the tokens of a text, none of a null one."""
    lists = shipped(__name__, "_token_lists", tokenizer, ids)

    def tokens(values: pa.Array) -> pa.Array:
        return lists(values)

    return df.withColumn(name, F.arrow_udf(tokens, "array<struct<" + "id:long," * ids + "index:int,start:int,end:int>>")(F.col(text)))


def overlapping(tokens: Column, start: Column, end: Column, eligible: Column | None = None) -> Column:
    """Indices of the tokens that share a character with [start, end), all or the eligible ones; none is an error."""
    inside = F.filter(tokens, lambda t: (t["end"] > t["start"]) & (t["start"] < end) & (t["end"] > start) & (F.lit(True) if eligible is None else F.array_contains(eligible, t["index"])))
    found = F.transform(inside, lambda t: t["index"])
    return F.when(F.size(found) > 0, found).otherwise(F.raise_error(F.lit("a span maps to no token")).cast("array<int>"))


def overlap_count(tokens: Column, start: Column, end: Column, eligible: Column | None = None) -> Column:
    return F.size(F.filter(tokens, lambda t: (t["end"] > t["start"]) & (t["start"] < end) & (t["end"] > start) & (F.lit(True) if eligible is None else F.array_contains(eligible, t["index"]))))


def prompt_token_map(tokens: Column, start: Column, end: Column) -> Column:
    """Structs (index, start, end) of the prompt's tokens inside a chunk that stands at [start, end), counted from its start."""
    inside = F.filter(tokens, lambda t: F.least(t["end"], end) > F.greatest(t["start"], start))
    return F.transform(inside, lambda t: F.struct(t["index"].alias("index"), (F.greatest(t["start"], start) - start).alias("start"), (F.least(t["end"], end) - start).alias("end")))


def required_lengths(spans: DataFrame, by: str, counts: Sequence[str]) -> DataFrame:
    """(by, counts): the most tokens that any span of a key maps to, by tokenizer; a tokenizer without any is an error."""
    most = lambda c: F.when(F.max(c) > 0, F.max(c)).otherwise(F.raise_error(F.lit(f"spans map to no token of {c}")).cast("int")).alias(c)
    return spans.groupBy(by).agg(*map(most, counts))


def long_enough(lengths: Sequence[Column], required: Sequence[Column]) -> Column:
    """Whether a donor has as many tokens as every tokenizer requires."""
    out = F.lit(True)
    for have, need in zip(lengths, required, strict=True):
        out = out & (have >= need)
    return out
