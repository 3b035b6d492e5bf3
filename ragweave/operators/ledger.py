"""Append-only ledgers: first rows win, quotas, samples, provenance and restarts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ragweave.sources.store import held

PROVENANCE = ["schema_version", "detector_code_commit", "model_revisions", "pipeline_config_sha256"]


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ledger order (file, line)."""
    best = F.min_by(F.struct(*(F.col(c) for c in rows.columns)), F.struct(*order))
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(best.alias("r")).select("r.*")


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    best = F.max_by(F.struct(*(F.col(c) for c in rows.columns)), F.struct(*order))
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(best.alias("r")).select("r.*")


def dense(rows: DataFrame, line: str, name: str) -> DataFrame:
    """rows with their place from 0, without gaps, where `line` numbers them as Spark numbers scanned rows: the split in
    the upper bits, from 0 within a split below. Nothing is shuffled; only the sizes of splits meet."""
    at, split = "__at", "__split"
    placed = rows.withColumn(at, F.col(line)).withColumn(split, F.shiftright(line, 33))
    return _moved(placed, placed.groupBy(split).agg((F.max(F.col(at).bitwiseAND((1 << 33) - 1)) + 1).alias("n")), at, split, name)


def _moved(placed: DataFrame, counts: DataFrame, at: str, split: str, name: str) -> DataFrame:
    """Places within splits, as spark numbers them, moved by the counts of the splits before; one count for each split."""
    below = F.coalesce(F.sum("n").over(W.orderBy(split).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = counts.select(split, below.alias("__below"))
    return placed.join(F.broadcast(before), split).withColumn(name, (F.col("__below") + F.col(at).bitwiseAND((1 << 33) - 1)).cast("long")).drop(at, split, "__below")


def numbered(rows: DataFrame, order: str | list[str], name: str, by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """rows with their number from 0 in `order`, within each group of `by` if given; nulls come first.

    Rows are dealt to ranges of the whole key (and of their place, so that equal keys are split as well), sorted there
    and written once; a range's numbers are moved by the rows of the ranges before it, a group's by its first number. So
    no task sorts more than a range, whatever the type of the key, and only counts meet.
    """
    order = [order] if isinstance(order, str) else order
    keys, at, split, tie, first = [*(by or []), *order], "__at", "__split", "__tie", "__first"
    tied = rows.withColumn(tie, F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(parts, *keys, tie) if parts else tied.repartitionByRange(*keys, tie)
    placed = held(ranged.sortWithinPartitions(*keys, tie).drop(tie).withColumn(at, F.monotonically_increasing_id()).withColumn(split, F.shiftright(at, 33)), "numbered")
    whole = _moved(placed, placed.groupBy(split).agg(F.count("*").alias("n")), at, split, name)
    if not by:
        return whole
    same = [F.col(f"__g{i}").eqNullSafe(F.col(k)) for i, k in enumerate(by)]
    start = whole.groupBy(*(F.col(k).alias(f"__g{i}") for i, k in enumerate(by))).agg(F.min(name).alias(first))
    on = same[0]
    for c in same[1:]:
        on = on & c
    return whole.join(start, on).withColumn(name, F.col(name) - F.col(first)).select(*rows.columns, name)


def within_quota(rows: DataFrame, quotas: DataFrame, family: str, order: list[str]) -> DataFrame:
    """The first rows of each family in ledger order, as many as its quota (family, quota) has; other families go.

    Quotas of up to 1000 leave each task that many rows of a family before the shuffle; larger ones number their
    families by ranges. Both keep the same rows.
    """
    most = 1000
    few = first_in_groups(rows.join(F.broadcast(quotas.where(F.col("quota") <= most)), family), [family], order, most, "_n").where("_n <= quota").select(*rows.columns)
    large = quotas.where(F.col("quota") > most)
    if large.isEmpty():
        return few
    return few.unionByName(numbered(rows.join(F.broadcast(large), family), order, "_n", [family]).where("_n < quota").select(*rows.columns))


def first_in_groups(rows: DataFrame, by: list[str], order: list[str], n: int, name: str = "") -> DataFrame:
    """The first n rows of each group; the number from 1 stays as column `name` if one is given."""
    kept = rows.withColumn(name or "__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name or "__n") <= n)
    return kept if name else kept.drop("__n")


def shortages(rows: DataFrame, quotas: DataFrame, family: str) -> DataFrame:
    """(family, quota, n) of families with fewer rows than their quota."""
    return quotas.join(rows.groupBy(family).count().withColumnRenamed("count", "n"), family, "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < quota")


def tenth(rows: DataFrame, key: str, fraction: float = 0.1) -> DataFrame:
    """A deterministic sample: by sha256 of the key, as many as fraction rounds to half even, one at least."""
    n = max(1, round(rows.count() * fraction))
    hashed = rows.withColumn("_h", F.sha2(F.col(key).cast("string"), 256))
    return numbered(hashed, ["_h", key], "_n").where(F.col("_n") < n).select(*rows.columns)


def matches(expected: dict[str, object]) -> Column:
    """Null-safe equality on every expected field."""
    out = F.lit(True)
    for k, v in expected.items():
        out = out & F.col(k).eqNullSafe(F.lit(v))
    return out


def stale(expected: dict[str, object]) -> Column:
    """Names of the fields on which a row's provenance differs from the expected one."""
    return F.filter(F.array(*(F.when(~F.col(k).eqNullSafe(F.lit(v)), F.lit(k)) for k, v in expected.items())), lambda x: x.isNotNull())


def checked(rows: DataFrame, expected: dict[str, object]) -> DataFrame:
    """rows, or an error that names the fields of the first row with stale or mixed provenance."""
    first = rows.columns[0]
    wrong = F.raise_error(F.concat(F.lit("stale or mixed provenance: "), F.array_join(stale(expected), ", "))).cast(dict(rows.dtypes)[first])
    return rows.withColumn(first, F.when(F.size(stale(expected)) > 0, wrong).otherwise(F.col(first)))


def eligible(rows: DataFrame, dataset: str) -> DataFrame:
    """Samples of a dataset that were retrieved and succeeded."""
    return rows.where((F.col("dataset") == dataset) & F.col("hit") & F.col("success"))


def admitted(results: DataFrame, statuses: list[str], expected: dict[str, object]) -> DataFrame:
    """Results of phases with an allowed status and the current provenance."""
    return results.where(F.col("status").isin(*statuses) & matches(expected))


def resumed(ledger: DataFrame, keys: list[str], order: list[str], expected: dict[str, object]) -> DataFrame:
    """Rows of the expected provenance, first per key: what a restart keeps."""
    return first_wins(ledger.where(matches(expected)), keys, order)


def remaining(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def merged(*ledgers: DataFrame) -> DataFrame:
    """One ledger with the ordinal of its source, which stands for the file order."""
    out = None
    for i, part in enumerate(ledgers):
        part = part.withColumn("source_no", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def lock_diff(local: DataFrame, official: DataFrame, name: str = "name", digest: str = "digest") -> DataFrame:
    """(name, status): missing_local, local_only, changed or identical, by a full outer join."""
    a, b = local.select(name, F.col(digest).alias("_l")), official.select(name, F.col(digest).alias("_o"))
    status = F.when(F.col("_l").isNull(), "missing_local").when(F.col("_o").isNull(), "local_only").when(F.col("_l") != F.col("_o"), "changed").otherwise("identical")
    return a.join(b, name, "full_outer").select(name, status.alias("status"))


def label_free(df: DataFrame, allowed: list[str], forbidden: set[str]) -> DataFrame:
    """A projection to allowed columns; a forbidden name at any depth of its schema is an error."""
    out = df.select(*allowed)

    def names(t):
        for f in getattr(t, "fields", []):
            yield f.name
            yield from names(f.dataType)
        for part in ("elementType", "keyType", "valueType"):
            if hasattr(t, part):
                yield from names(getattr(t, part))

    if leaked := sorted(set(names(out.schema)) & forbidden):
        raise ValueError(f"forbidden columns: {leaked}")
    return out


def with_samples(rows: DataFrame, samples: DataFrame, order: list[str], key: str = "sample_id") -> DataFrame:
    """Ledger rows with the sample of their key; of samples that share one the last counts, a key that none has is an error."""
    last = last_wins(samples, [key], order).drop(*(c for c in order if c in rows.columns)).withColumn("_there", F.lit(True))
    both = rows.join(last, key, "left")
    known = F.when(F.col("_there"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no sample "), F.col(key).cast("string"))).cast(dict(rows.dtypes)[key]))
    return both.withColumn(key, known).drop("_there")


def with_last(tasks: DataFrame, log: DataFrame, keys: list[str], epoch: str, value: str) -> DataFrame:
    """Tasks with the value of their last epoch and a status: found, or missing where the log has none."""
    last = log.groupBy(*keys).agg(F.max(epoch).alias(epoch), F.max_by(value, F.struct(epoch, value)).alias(value))
    return tasks.join(last, keys, "left").withColumn("status", F.when(F.col(epoch).isNull(), "missing").otherwise("found"))


def merged_shards(rows: DataFrame, shard: str, line: str | list[str], key: str) -> DataFrame:
    """Rows with row_id 0..n-1 in order of shard and line; a key that comes twice is an error."""
    lines = [line] if isinstance(line, str) else line
    own = numbered(rows, [shard, *lines], "row_id").withColumn("_c", F.count("*").over(W.partitionBy(key)))
    once = F.when(F.col("_c") == 1, F.col("row_id")).otherwise(F.raise_error(F.lit("a key comes twice")).cast("long"))
    return own.withColumn("row_id", once).drop("_c")


def unmatched(scored: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one side only; none if the scorer saw exactly the candidates."""
    a, b = scored.select(key).distinct().withColumn("_a", F.lit(True)), candidates.select(key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full_outer").where("_a is null or _b is null").select(key, F.when(F.col("_b").isNull(), "scored").otherwise("candidate").alias("side"))


def record_hash(*columns: str) -> Column:
    """SHA-256 of the columns as one JSON object, in the order given; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
