"""Quality rules: base counts of each text, and lines that too many documents of a host share.

Native: whole texts stay in Spark's own expressions. Normalised lines are hashed, distinct documents are counted for
each host and line, lines above the limit are taken out, and a document that loses too many words is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut

WINDOW, LINE_DOCS, LEAST_WORDS, LEAST_SHARE = 8, 20, 20, 0.5
_SPLIT = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _SPLIT), lambda w: w != "")


def normalised_line(line: Column) -> Column:
    """Lower case, digits as 0, runs of blanks as one."""
    return F.trim(F.regexp_replace(F.translate(F.lower(line), "123456789", "000000000"), _SPLIT, " "))


def _windows(hashes: Column, width: int) -> Column:
    """A hash of each `width` consecutive words, none if there are fewer."""
    return F.when(F.size(hashes) >= width, F.transform(F.sequence(F.lit(0), F.size(hashes) - width), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(width))))).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column, width: int) -> Column:
    """Words in windows found twice or more: positions of such windows, in order, and what each adds."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s, i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
    # transform over a one-element array binds the sorted pairs once
    at = F.flatten(F.transform(F.array(pairs), lambda s: F.transform(F.filter(s, lambda x, i: ((i > 0) & same(s, i, F.greatest(i - 1, F.lit(0)))) | same(s, i, i + 1)), lambda x: x["i"])))
    # the ends of covered runs: each position adds width words less what the position before has already covered
    return F.aggregate(F.sort_array(at), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + i + width - F.greatest(a["end"], i)).cast("long").alias("n"), (i + width).alias("end")), lambda a: a["n"])


def base(docs: DataFrame, *more: str) -> DataFrame:
    """docs.doc_id with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and `more`."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", *more, text.alias("text"))
    rows = rows.select("*", words_of(F.col("text")).alias("_w"), F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("_lines"))
    # one column for each step: an expression that is repeated inside a lambda would run again for each element
    rows = rows.withColumn("_hw", F.transform("_w", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("_h", _windows(F.col("_hw"), WINDOW))
    rows = rows.select(
        "doc_id",
        *more,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.lit(0).cast("long")).otherwise(_covered(F.col("_h"), WINDOW)).alias("n_repeat_words"),
        F.transform("_lines", lambda x: F.struct(F.xxhash64(normalised_line(x)).alias("line"), F.size(words_of(x)).alias("words"))).alias("lines"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def judged(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per row of docs: doc_id, base counts, base_failed, left_words, kept.

    A line that more than line_docs distinct documents of a host have is taken out wherever that host has it. kept
    is false if base_failed, or if fewer than least_words words or less than least_share of the words are left.
    Null texts have no words and fail. Documents of a null host share one host; null doc_ids count as one document.
    """
    marked = cut(base(docs.withColumn("_host", F.coalesce(F.xxhash64(F.col(host).cast("string")), F.lit(0))), "_host").withColumn("_row", F.monotonically_increasing_id()), "lines")
    each = marked.select("_row", "_host", F.coalesce(F.xxhash64("doc_id"), F.lit(0)).alias("_doc"), F.explode("lines").alias("_l")).select("_row", "_host", "_doc", "_l.line", "_l.words")
    common = each.groupBy("_host", "line").agg(F.count_distinct("_doc").alias("n")).where(F.col("n") > line_docs).select("_host", "line")
    lost = each.groupBy("_row", "_host", "line").agg(F.sum("words").alias("words")).join(common, ["_host", "line"]).groupBy("_row").agg(F.sum("words").alias("lost"))
    out = marked.join(lost, "_row", "left").withColumn("left_words", F.col("n_words") - F.coalesce("lost", F.lit(0)))
    depleted = (F.col("left_words") < least_words) | (F.col("left_words") < least_share * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "left_words", (~F.col("base_failed") & ~depleted).alias("kept"))


def op10_line_rules(spark, sf_dir) -> DataFrame:
    """Query: base counts and the verdict on every document."""
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("left_words")


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, doc_id, host, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g') <> '') AS ls FROM d),
win AS (
  SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range({WINDOW})) AS k) q GROUP BY r),
l AS (SELECT r, doc_id, host, unnest(ls) AS line FROM w),
ll AS (
  SELECT r, doc_id, host, trim(regexp_replace(translate(lower(line), '123456789', '000000000'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS line,
         len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS words FROM l),
common AS (SELECT host, line FROM ll GROUP BY host, line HAVING count(DISTINCT doc_id) > {LINE_DOCS}),
lost AS (SELECT r, sum(words) AS lost FROM ll JOIN common USING (host, line) GROUP BY r),
base AS (
  SELECT w.r, w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost.lost, 0) AS lost
  FROM w LEFT JOIN rep USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 30 * n_words) AND n_words - lost >= {LEAST_WORDS} AND n_words - lost >= {LEAST_SHARE} * n_words AS kept
FROM base
"""
