"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

Native: spans, scores and redaction are Spark expressions over whole texts. One model is trained on random strings,
the other on ordinary identifiers and words; the table of log ratios between their transitions is a literal in the
plan, of fixed size. A candidate run of characters, or what base patterns leave of it, is a secret if its summed ratio
is above a threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named

#: Base patterns by kind, in the order in which kinds are listed.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}"}
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
LEAST, THRESHOLD, SAMPLE_DOCS, SAMPLE_STRINGS = 16, 7.0, 400, 4000
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Parts of ordinary identifiers.
PARTS = "get set user name value index count total list item node file path line word text data type key map size time date page view load save read write open close start end first last next prev old new max min sum mean test main app server client request response error message status code session cache config table column row query result handler manager service factory builder default update delete create insert select number version".split()


def found(text: Column, pattern: str) -> tuple[Column, Column]:
    """(matches, texts between them): together they give the position of each match."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


#: Entries that a running sum takes together: n entries cost n * BLOCK + (n / BLOCK)**2 steps.
BLOCK = 256
_SPAN = "array<struct<start:int,order:int,kind:string,end:int,token:string,at:int,upto:int>>"


def _plus(x: Column, y: Column) -> Column:
    return F.struct((x["a"] + y["a"]).alias("a"), (x["b"] + y["b"]).alias("b"))


def blocks(entries: Column) -> Column:
    """An array in pieces of BLOCK entries; each entry is got by its place, as a slice would copy the whole array."""
    n = F.size(entries)
    piece = lambda i: F.transform(F.sequence(i * BLOCK, F.least(i * BLOCK + BLOCK, n) - 1), lambda j: F.get(entries, j))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), piece)).otherwise(F.array().cast("array<array<struct<a:int,b:int>>>"))


def running(pieces: str) -> Column:
    """Sums before each of the entries (a, b) that blocks() cut: within a block entry by entry, from the sums of the blocks before."""
    zero = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))
    append = lambda out, x: F.concat(out, F.array(_plus(F.element_at(out, -1), x)))
    totals = F.transform(pieces, lambda p: F.aggregate(p, zero, _plus))
    before = F.aggregate(totals, F.array(zero), append)
    each = F.zip_with(F.col(pieces), F.slice(before, F.lit(1), F.size(pieces)), lambda p, start: F.slice(F.aggregate(p, F.array(start), append), F.lit(1), F.size(p)))
    return F.flatten(each)


def lengths(matches: str, gaps: str) -> Column:
    """Characters and bytes of each match and of the text between it and the match before."""
    return F.transform(matches, lambda m, i: F.struct((F.length(F.get(gaps, i)) + F.length(m)).alias("a"), (F.octet_length(F.get(gaps, i)) + F.octet_length(m)).alias("b")))


def placed(matches: str, gaps: str, sums: str, kind: str, order: int) -> Column:
    """Structs (start, order, kind, end, token, at, upto) in order: places in code points and in bytes, ends exclusive."""
    start, at = lambda s, i: s["a"] + F.length(F.get(gaps, i)), lambda s, i: s["b"] + F.octet_length(F.get(gaps, i))
    span = lambda s, i: F.struct(start(s, i).alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), (start(s, i) + F.length(F.get(matches, i))).alias("end"), F.get(matches, i).alias("token"), at(s, i).alias("at"), (at(s, i) + F.octet_length(F.get(matches, i))).alias("upto"))
    return F.coalesce(F.transform(sums, span), F.array().cast(_SPAN))


def samples(spark: SparkSession, docs: DataFrame | None, strings: int = SAMPLE_STRINGS, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(token, random): labelled samples. Random strings come from digests, ordinary ones from PARTS and from the
    words of at most sample_docs documents, those with the least hash of doc_id."""
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 512)
    size = (F.col("id") % 25 + 16).cast("int")
    packed = F.base64(F.unhex(digest))
    kinds = F.array(packed, F.translate(packed, "+/=", ""), F.upper(F.translate(packed, "+/=", "")), digest, F.translate(F.translate(packed, "+/", "-_"), "=", ""))
    random = spark.range(strings).select(F.substring(F.element_at(kinds, (F.col("id") % 5 + 1).cast("int")), F.lit(1), size).alias("token"), F.lit(True).alias("random"))
    parts = F.split(F.lit(" ".join(PARTS)), " ")
    part = lambda k: F.element_at(parts, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    p = [part(k) for k in range(4)]
    shapes = F.array(F.concat_ws("_", *p), F.concat_ws("-", *p[:3]), F.concat(p[0], *(F.initcap(x) for x in p[1:])), F.upper(F.concat_ws("_", *p[:3])), F.concat_ws("/", *p), F.concat(p[0], F.initcap(p[1]), (F.col("id") % 100).cast("string")), F.repeat((F.col("id") % 9000 + 1000).cast("string"), 4), F.repeat(F.element_at(F.split(F.lit("- _ = / +"), " "), (F.floor(F.col("id") / 9) % 5 + 1).cast("int")), 24), F.date_format(F.timestamp_seconds(F.col("id") * 7654321), "yyyy-MM-dd-HH-mm-ss"))
    plain = spark.range(strings).select(F.element_at(shapes, (F.col("id") % 9 + 1).cast("int")).alias("token"), F.lit(False).alias("random"))
    out = random.union(plain)
    if docs is not None:
        ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
        few = docs.select("doc_id", "text").join(F.broadcast(ids.distinct()), "doc_id", "left_semi")  # sample_docs ids at most
        words = few.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("w")).distinct()
        out = out.union(words.select(F.explode(F.array("w", F.upper("w"), F.lower("w"))).alias("token"), F.lit(False).alias("random")))
    return out


def trained(labelled: DataFrame, alpha: float = 0.5) -> list[float]:
    """Log ratios of transition probabilities, random over ordinary, by (previous, next) in ALPHABET order."""
    n = len(ALPHABET)
    pair = labelled.where(F.length("token") > 1).select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2)))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["count"] for r in pair.groupBy("random", "pair").count().collect()}  # two at most for each pair of letters
    table = []
    for a in ALPHABET:
        row = {k: [counts.get((k, a + b), 0) + alpha for b in ALPHABET] for k in (True, False)}
        table += [math.log(x / sum(row[True])) - math.log(y / sum(row[False])) for x, y in zip(row[True], row[False])]
    assert len(table) == n * n
    return [round(x, 2) for x in table]


def ratio(token: Column, table: list[float]) -> Column:
    """Summed log-likelihood ratio of a token's transitions."""
    literal = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))) - 1
    return F.aggregate(F.sequence(F.lit(2), F.length(token)), F.lit(0.0), lambda a, i: a + F.coalesce(F.get(literal, F.expr("0") + (place(i - 1) * len(ALPHABET) + place(i)).cast("int")), F.lit(0.0)))


def _sweep(entries: Column, rows: DataFrame, name: str) -> DataFrame:
    """rows with an array of (place, next, a, b): each entry (place, a, b), in order, with the place of the next one and the
    sums of a and b up to and with it."""
    e, each, cut, sums = f"{name}_e", f"{name}_l", f"{name}_b", f"{name}_s"
    rows = rows.withColumn(e, F.array_sort(entries)).withColumn(each, F.transform(e, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))
    rows = rows.withColumn(cut, blocks(F.col(each)))
    rows = rows.withColumn(sums, running(cut))
    state = lambda s, k: F.struct(F.get(e, k)["place"].alias("place"), F.get(e, k + 1)["place"].alias("next"), (s["a"] + F.get(e, k)["a"]).alias("a"), (s["b"] + F.get(e, k)["b"]).alias("b"))
    return rows.withColumn(name, F.coalesce(F.transform(sums, state), F.array().cast("array<struct<place:int,next:int,a:int,b:int>>"))).drop(e, each, cut, sums)


def _ends(spans: str, of: tuple[str, str], mark) -> Column:
    """Entries at both ends of each span; mark gives (a, b) of one that opens, which its end takes back."""
    def ends(s, i):
        a, b = mark(i)
        return F.array(F.struct(s[of[0]].alias("place"), a.alias("a"), b.alias("b")), F.struct(s[of[1]].alias("place"), (-a).alias("a"), (-b).alias("b")))

    return F.flatten(F.transform(spans, ends))


def scanned(docs: DataFrame, table: list[float], *more: str, threshold: float = THRESHOLD) -> DataFrame:
    """docs' doc_id and `more` with base (spans of the patterns) and spans (base and Markov ones, in order).

    Work grows with the length of a text and, but for running sums by blocks, with its number of matches: one sweep over all
    places where a candidate or a base span starts or ends finds the pieces of candidates outside every base span.
    """
    rows = docs.select("doc_id", *more, F.coalesce("text", F.lit("")).alias("_t"))
    kinds = [*KINDS.items(), ("random", CANDIDATE)]
    for kind, pattern in kinds:
        matches, _ = found(F.col("_t"), pattern)
        rows = rows.withColumn(f"_m_{kind}", matches)
        rows = rows.withColumn(f"_g_{kind}", F.when(F.size(f"_m_{kind}") > 0, F.split("_t", pattern, -1)))
    # each step is a column of its own, as a function of every block would otherwise make what it reads anew
    rows = rows.drop("_t").select("*", *(lengths(f"_m_{k}", f"_g_{k}").alias(f"_l_{k}") for k, _ in kinds))
    rows = rows.select("*", *(blocks(F.col(f"_l_{k}")).alias(f"_b_{k}") for k, _ in kinds))
    rows = rows.select("*", *(running(f"_b_{k}").alias(f"_s_{k}") for k, _ in kinds))
    rows = rows.select("doc_id", *more, *(placed(f"_m_{k}", f"_g_{k}", f"_s_{k}", k, i).alias(f"_{k}") for i, (k, _) in enumerate(kinds)))
    rows = rows.withColumn("_assign", F.filter("_assign", lambda s: F.length(F.regexp_extract(s["token"], ASSIGN, 2)) >= 8))
    rows = rows.withColumn("base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    zero = F.lit(0)
    # candidates never overlap, so the sum of a is the number, from 1, of the one that is open
    entries = F.concat(_ends("_random", ("start", "end"), lambda i: (i + 1, zero)), _ends("base", ("start", "end"), lambda i: (zero, F.lit(1))))
    rows = _sweep(entries, rows, "_open")
    piece = lambda p, c: F.struct(p["place"].alias("start"), c["order"].alias("order"), c["kind"].alias("kind"), p["next"].alias("end"), F.substring(c["token"].cast("binary"), p["place"] - c["start"] + 1, p["next"] - p["place"]).cast("string").alias("token"), (c["at"] + p["place"] - c["start"]).alias("at"), (c["at"] + p["next"] - c["start"]).alias("upto"))
    free = F.filter("_open", lambda p: (p["a"] > 0) & (p["b"] == 0) & (p["next"] - p["place"] >= LEAST))
    rows = rows.withColumn("_pieces", F.transform(free, lambda p: piece(p, F.get("_random", p["a"] - 1))))
    rows = rows.withColumn("_random", F.filter("_pieces", lambda s: ratio(s["token"], table) > threshold))
    return rows.withColumn("spans", F.array_sort(F.concat("base", "_random"))).drop("_open", "_pieces", *(f"_{k}" for k, _ in kinds))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A null text is empty and has no spans; spans may overlap among base kinds. Markov spans never overlap a base one: a
    candidate is cut at base spans, and each piece of LEAST characters or more outside them is judged by itself.
    """
    rows = scanned(docs, trained(samples(docs.sparkSession, docs)), threshold=threshold)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """docs with each run of secret characters replaced by mark, and n_chars, where present, counted anew.

    Texts without a secret, nulls among them, stay as they are.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    table = trained(samples(docs.sparkSession, docs))
    # other columns travel in one struct, so that their names cannot clash
    rows = scanned(docs.select("doc_id", "text", (F.struct(*map(named, rest)) if rest else F.lit(0)).alias("rest")), table, "text", "rest", threshold=threshold)
    # what no span covers, in bytes: from the front, and from wherever the last open span ends
    rows = _sweep(_ends("spans", ("at", "upto"), lambda i: (F.lit(1), F.lit(0))), rows.withColumn("_bytes", F.col("text").cast("binary")), "_cover")
    part = lambda at, upto: F.substring("_bytes", at + 1, upto - at).cast("string")
    rest_of = F.transform(F.filter("_cover", lambda p: p["a"] == 0), lambda p: part(p["place"], F.coalesce(p["next"], F.length("_bytes"))))
    masked = F.array_join(F.concat(F.array(part(F.lit(0), F.get("_cover", 0)["place"])), rest_of), mark)
    rows = rows.withColumn("_masked", F.when(F.size("spans") > 0, masked).otherwise(F.col("text")))
    out = {"doc_id": F.col("doc_id"), "text": F.col("_masked")} | {c: F.col("rest").getField(c) for c in rest}
    if "n_chars" in rest:
        out["n_chars"] = F.when(F.size("spans") > 0, F.length("_masked").cast(dict(docs.dtypes)["n_chars"])).otherwise(out["n_chars"])
    return rows.select(*(out[c].alias(c) for c in docs.columns))


def op8_secrets(spark, sf_dir) -> DataFrame:
    """Query: secrets in every document."""
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
