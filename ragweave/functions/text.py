"""Text, range and token functions: span views, prompts, answers, interventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = "array<struct<start:int,end:int>>"


def chunk_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of windows over n tokens; the first window that reaches the end is the last one."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    return F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s - step + size < n))


def span_views(n: Column, size: int = 32, offsets: tuple[int, ...] = (0, 16)) -> Column:
    """Structs (view, start, end) of token windows over n tokens for each view that starts inside them."""
    view = lambda v: F.when(n > v, F.transform(F.sequence(F.lit(v), n - 1, F.lit(size)), lambda s: F.struct(F.lit(v).alias("view"), s.cast("int").alias("start"), F.least(s + size, n).cast("int").alias("end")))).otherwise(F.array().cast("array<struct<view:int,start:int,end:int>>"))
    return F.flatten(F.array(*map(view, offsets)))


def overlap(s1, e1, s2, e2) -> Column:
    """Length of the overlap of two half-open ranges."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def clipped(ranges: Column, start: Column, end: Column) -> Column:
    """Ranges cut to [start, end) and counted from start; those outside go."""
    inside = F.filter(ranges, lambda r: (r["start"] < end) & (r["end"] > start))
    return F.transform(inside, lambda r: F.struct((F.greatest(r["start"], start) - start).alias("start"), (F.least(r["end"], end) - start).alias("end")))


def all_present(projected: Column, originals: Column) -> Column:
    """Whether every original range stands among the projected ones, start and end equal."""
    return F.forall(originals, lambda o: F.exists(projected, lambda p: (p["start"] == o["start"]) & (p["end"] == o["end"])))


def normalised(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def contains_answer(output: Column, answer: Column) -> Column:
    """Whether the normalised answer, if not empty, occurs in the normalised output."""
    return (F.length(normalised(answer)) > 0) & F.contains(normalised(output), normalised(answer))


#: Words that mark a refusal in a normalised answer.
REFUSALS = ["cannot", "can not", "unable", "sorry"]


def command_success(output: Column, target: Column, command: Column) -> Column:
    """Success of an instruction: leading target words, a prescribed beginning, a refusal, or the target itself."""
    out, words = normalised(output), F.split(normalised(target), " ")
    lead = F.array_join(F.slice(words, 1, 3), " ")
    low = F.lower(command)
    opening = "start answer with"
    after = F.substring(low, F.instr(low, opening) + len(opening), F.length(low))  # after the first one, whatever follows
    marker = F.array_join(F.slice(F.filter(F.split(after, r"\s+"), lambda w: w != ""), 1, 3), " ")
    refusal = F.lit(False)
    for m in REFUSALS:
        refusal = refusal | out.contains(m)
    return F.when((F.size(words) >= 3) & out.contains(lead), True).when(low.contains("start answer with"), (marker != "") & F.startswith(out, marker)).when(low.contains("do not answer") | low.contains("refuse"), refusal).otherwise(contains_answer(output, target))


def final_answer(text: Column, strict: bool = False) -> Column:
    """The first non-empty answer line; without one null, or an error if strict."""
    found = F.regexp_extract(text, r"(?id)(?:^|\n)\s*FINAL_ANSWER\s*:\s*(.+?)\s*(?:\n|$)", 1)
    missing = F.raise_error(F.lit("no answer line")) if strict else F.lit(None).cast("string")
    return F.when(found != "", found).otherwise(missing)


def first_or(array: Column, default: str = "") -> Column:
    return F.coalesce(F.get(array, 0), F.lit(default))


#: The lines around the contexts of a prompt.
HEAD = "Answer the query using only the supplied contexts. Be short and factual.\nReturn exactly one non-empty line in this form: FINAL_ANSWER: <answer>\n\n"
TAIL = "\n\nASSISTANT:\nFINAL_ANSWER: "


def prompt_of(query: Column, contexts: str) -> tuple[Column, Column]:
    """(prompt, ranges) from an array column of (position, chunk, text) in order; ranges give each text's place by chunk."""
    label = lambda x: F.concat(F.lit("CONTEXT["), x["position"].cast("string"), F.lit("]:\n"))
    block = lambda x: F.concat(label(x), x["text"], F.lit("\n\n"))
    before = lambda i: F.aggregate(F.slice(contexts, F.lit(1), i), F.lit(len(HEAD)), lambda a, x: a + F.length(block(x)))
    start = lambda x, i: before(i) + F.length(label(x))
    ranges = F.transform(contexts, lambda x, i: F.struct(x["chunk"].alias("chunk"), start(x, i).alias("start"), (start(x, i) + F.length(x["text"])).alias("end")))
    return F.concat(F.lit(HEAD), F.array_join(F.transform(contexts, block), ""), F.lit("QUERY:\n"), query, F.lit(TAIL)), ranges


def prompts(contexts: DataFrame, by: str, query: str, position: str, chunk: str, text: str) -> DataFrame:
    """(by, prompt, ranges): one prompt per key, contexts by position; ranges give each context's place by chunk."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("position"), F.col(chunk).alias("chunk"), F.col(text).alias("text"))))
    grouped = contexts.groupBy(by).agg(F.first(query).alias("_query"), ordered.alias("_c"))
    prompt, ranges = prompt_of(F.col("_query"), "_c")
    return grouped.select(by, prompt.alias("prompt"), ranges.alias("ranges"))


def occurrence(text: Column, needle: Column, nth: int = 0) -> Column:
    """0-based start of the nth (from 0) non-overlapping occurrence; an error if there is none."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), needle, F.lit("\\E")), -1)
    at = F.aggregate(F.slice(pieces, 1, nth + 1), F.lit(0), lambda a, p: a + F.length(p)) + nth * F.length(needle)
    return F.when((F.length(needle) > 0) & (F.size(pieces) > nth + 1), at).otherwise(F.raise_error(F.lit("chunk not found in prompt")).cast("int"))


def hidden(ids: Column, mask: Column, start: Column, end: Column, neutral: Column, allowed: Column) -> Column:
    """Struct (ids, mask): inside [start, end) ids become neutral and mask 0; protected places are an error. Positions stay."""
    inside = lambda i: (i >= start) & (i < end)
    bad = F.exists(F.sequence(start, end - 1), lambda i: ~F.array_contains(allowed, i))
    guard = lambda c: F.when(bad, F.raise_error(F.lit("span touches protected tokens")).cast("array<int>")).otherwise(c)
    return F.struct(guard(F.transform(ids, lambda x, i: F.when(inside(i), neutral).otherwise(x).cast("int"))).alias("ids"), F.transform(mask, lambda x, i: F.when(inside(i), 0).otherwise(x).cast("int")).alias("mask"))


def replaced(ids: Column, start: Column, end: Column, donor: Column) -> Column:
    """ids with [start, end) replaced by a donor of the same length; another length is an error."""
    made = F.concat(F.slice(ids, F.lit(1), start), donor, F.slice(ids, end + 1, F.greatest(F.size(ids) - end, F.lit(0))))
    return F.when(F.size(donor) == end - start, made).otherwise(F.raise_error(F.lit("donor length differs from span")).cast("array<int>"))


def donor_prefix(ids: Column, length: Column) -> Column:
    return F.when(F.size(ids) >= length, F.slice(ids, F.lit(1), length)).otherwise(F.raise_error(F.lit("donor too short")).cast("array<int>"))


def neutral_token(pad: Column, unk: Column, eos: Column) -> Column:
    return F.coalesce(pad, unk, eos)


def mean_answer_logprob(logits: Column, labels: Column, mask: Column) -> Column:
    """Mean log-probability of labels t >= 1 under mask, each from the logits of t - 1; non-finite values are errors."""
    top = lambda row: F.array_max(row)
    norm = lambda row: top(row) + F.log(F.aggregate(row, F.lit(0.0), lambda a, x: a + F.exp(x - top(row))))
    at = F.filter(F.sequence(F.lit(1), F.size(labels) - 1), lambda t: F.get(mask, t))
    each = F.transform(at, lambda t: F.element_at(F.get(logits, t - 1), F.get(labels, t).cast("int") + 1) - norm(F.get(logits, t - 1)))
    mean = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(each)
    return F.when(F.size(each) > 0, finite(mean, "answer log-probability")).otherwise(F.raise_error(F.lit("no answer tokens")).cast("double"))


def finite(x: Column, name: str) -> Column:
    """x, or an error if it is null, NaN or infinite."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"{name} is not finite")).cast("double")).otherwise(x)
