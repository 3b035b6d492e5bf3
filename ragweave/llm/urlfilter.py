"""URL filters: host and path rules, then a blocked Bloom filter of listed canonical URLs before an exact join.

A block of the filter is 512 bits, so one URL touches one cache line. Its parts are built where the listed URLs of
those blocks meet, so that only the filter itself, of at most `max_bytes`, reaches the driver and the executors.
URLs that may be listed go on to an exact equi-join, which removes false positives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mixed, shipped

BITS, PROBES, MAX_BYTES = 16, 8, 32 << 20
#: Fixed values: (verdict, host, path) of the rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The listed URLs of the query: each site under each domain, language and number below 1000.
SITES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
DOMAINS, LANGUAGES, NUMBERS = ["com", "net", "org"], ["de", "en", "es", "fr"], 1000
#: Labels before a site's name that don't change what is listed.
MIRRORS = ["blog", "m", "www"]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.when(url.contains("://"), lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def canonical(host: Column, path: Column) -> Column:
    """host without one mirror label, and path without .html and slashes at its end; of a URL without host, null."""
    plain = F.regexp_replace(host, f"^({'|'.join(MIRRORS)})\\.", "")
    return F.when(host != "", F.concat(plain, F.regexp_replace(path, r"(\.html)?/*$", "")))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, bits within it) of hashes."""
    h = h.view(np.uint64)
    block = ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
    spread = [mixed(h ^ np.uint64(i)) for i in (1, 2)]
    at = np.stack([(spread[i // 7] >> np.uint64(9 * (i % 7))) & np.uint64(511) for i in range(PROBES)], axis=1).astype(np.int64)
    return block, at


def _part(batches, blocks):
    """Rows sorted by block: one run of words for each block that has a URL."""
    for batch in batches:
        block, at = _bits(batch.column(0).to_numpy(zero_copy_only=False), blocks)
        if not len(block):
            continue
        own, where = np.unique(block, return_inverse=True)
        words = np.zeros((len(own), 8), np.uint64)
        np.bitwise_or.at(words, (where[:, None], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()]), pa.array([words.tobytes()])], names=["block", "words"])


def _probed(batches, filter_, blocks):
    words = filter_.value
    for batch in batches:
        h = batch.column(0)
        block, at = _bits(h.fill_null(0).to_numpy(zero_copy_only=False), blocks)
        hit = ((words[block[:, None], at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1) & ~h.is_null().to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(hit)], names=[*batch.schema.names[1:], "maybe"])


def bloom(listed: DataFrame, max_bytes: int = MAX_BYTES) -> tuple[np.ndarray, int]:
    """(words by block, blocks) of listed.canonical. A list too long for max_bytes only passes more on to the join."""
    hashes = listed.select(F.xxhash64("canonical").alias("h"))
    blocks = max(1, min(max_bytes // 64, -(-hashes.count() * BITS // 512)))
    words = np.zeros((blocks, 8), np.uint64)
    dealt = hashes.repartition(F.pmod(F.shiftrightunsigned("h", 32), F.lit(max(1, blocks))).cast("long"))
    for own, found in dealt.mapInArrow(shipped(__name__, "_part", blocks), "block binary, words binary").toLocalIterator():
        own, found = np.frombuffer(own, np.int64), np.frombuffer(found, np.uint64).reshape(-1, 8)
        words[own] |= found
    return words, blocks


def judged(pages: DataFrame, listed: DataFrame, rules=RULES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, canonical, listed.

    listed: a frame with the column canonical; nulls and repeats in it don't count. A null URL, or one without
    "://", has an empty host and path, no canonical form, no rule, and is allowed.
    """
    listed = listed.select("canonical").where("canonical is not null").distinct()
    words, blocks = bloom(listed, max_bytes)
    url = F.col("url")
    rows = pages.select("page_id", F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select(canonical(F.col("host"), F.col("path")).alias("canonical"), "page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    rows = rows.select(F.when(F.col("canonical").isNotNull(), F.xxhash64("canonical")).alias("h"), "page_id", "host", "path", "rule", "by_rule", "canonical")
    kind = dict(pages.dtypes)["page_id"]
    filter_ = pages.sparkSession.sparkContext.broadcast(words)
    probed = cut(rows.mapInArrow(shipped(__name__, "_probed", filter_, blocks), f"page_id {kind}, host string, path string, rule string, by_rule string, canonical string, maybe boolean"), "urls")
    sure = probed.where("not maybe").withColumn("listed", F.lit(False))
    hits = probed.where("maybe").join(listed.withColumn("listed", F.lit(True)), "canonical", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    both = sure.unionByName(hits)
    return both.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "canonical", "listed")


def listed_urls(spark: SparkSession) -> DataFrame:
    """The listed canonical URLs of the query, by rule from SITES, DOMAINS, LANGUAGES and NUMBERS."""
    total = len(SITES) * len(DOMAINS) * len(LANGUAGES) * NUMBERS
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    i = F.col("id")
    number, i = i % NUMBERS, F.floor(i / NUMBERS)
    language, i = i % len(LANGUAGES), F.floor(i / len(LANGUAGES))
    domain, site = i % len(DOMAINS), F.floor(i / len(DOMAINS))
    return spark.range(total).select(F.concat(pick(SITES, site), F.lit(".example."), pick(DOMAINS, domain), F.lit("/"), pick(LANGUAGES, language), F.lit("/"), number.cast("string")).alias("canonical"))


def op6_url_filter(spark, sf_dir) -> DataFrame:
    """Query: the verdict on the url of every page."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), listed_urls(spark)).select("page_id", "host", "path", "rule", "verdict")


_names = lambda names: ", ".join(f"('{n}')" for n in names)
SQL = f"""
WITH parts AS (
  SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
listed AS (
  SELECT s.v || '.example.' || d.v || '/' || l.v || '/' || CAST(n.v AS VARCHAR) AS canonical
  FROM (VALUES {_names(SITES)}) s(v), (VALUES {_names(DOMAINS)}) d(v), (VALUES {_names(LANGUAGES)}) l(v), (SELECT unnest(range({NUMBERS})) AS v) n),
named AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
         CASE WHEN host <> '' THEN regexp_replace(host, '^({'|'.join(MIRRORS)})\\.', '') || regexp_replace(path, '(\\.html)?/*$', '') END AS canonical
  FROM split)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM named
"""
