"""Span effects, atoms, role maps, oracle masses and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ragweave.functions.text import finite, overlap

FLOOR, TOLERANCE = 1e-8, 1e-12


def retrieval_effect(full: Column, hidden: Column) -> Column:
    return finite(full - hidden, "retrieval effect")


def generation_effect(full: Column, hidden: Column) -> Column:
    return finite(full - hidden, "generation effect")


def atoms(spans: DataFrame, *keys: str) -> DataFrame:
    """(keys, start, end, r_eff, g_eff): ranges between neighbouring endpoints, with the mean effects of the spans that cover them.

    One sweep over endpoints: effects are summed from span starts and taken off at span ends, so that no span has to
    meet every atom it covers. Uncovered gaps are dropped.
    """
    edge = spans.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("n"), F.col("r_eff").alias("r"), F.col("g_eff").alias("g")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("n"), (-F.col("r_eff")).alias("r"), (-F.col("g_eff")).alias("g")))).alias("x")).select(*keys, "x.*")
    points = edge.groupBy(*keys, "at").agg(F.sum("n").alias("n"), F.sum("r").alias("r"), F.sum("g").alias("g"))
    order = W.partitionBy(*keys).orderBy("at")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = points.select(*keys, F.col("at").alias("start"), F.lead("at").over(order).alias("end"), F.sum("n").over(upto).alias("n"), F.sum("r").over(upto).alias("r"), F.sum("g").over(upto).alias("g"))
    return swept.where("n > 0 and end is not null").select(*keys, "start", "end", (F.col("r") / F.col("n")).alias("r_eff"), (F.col("g") / F.col("n")).alias("g_eff"))


def role_map(atom: DataFrame, *keys: str, r_floor: float = FLOOR, g_floor: float = FLOOR, tolerance: float = TOLERANCE) -> DataFrame:
    """Atoms with p_r, p_g, role, and per key r_mass, g_mass, identifiable, t_rg (total variation, 0 to 1)."""
    key = W.partitionBy(*keys)
    r, g = F.greatest(finite(F.col("r_eff"), "retrieval effect"), F.lit(0.0)), F.greatest(finite(F.col("g_eff"), "generation effect"), F.lit(0.0))
    out = atom.withColumn("r_mass", F.sum(r).over(key)).withColumn("g_mass", F.sum(g).over(key))
    out = out.withColumn("identifiable", (F.col("r_mass") > r_floor) & (F.col("g_mass") > g_floor))
    share = lambda x, total: F.when(F.col("identifiable"), x / F.col(total)).otherwise(0.0)
    out = out.withColumn("p_r", share(r, "r_mass")).withColumn("p_g", share(g, "g_mass"))
    out = out.withColumn("role", F.when(F.col("p_r") > F.col("p_g") + tolerance, "anchor-like").when(F.col("p_g") > F.col("p_r") + tolerance, "payload-like").otherwise("mixed"))
    return out.withColumn("t_rg", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 * F.sum(F.abs(F.col("p_r") - F.col("p_g"))).over(key))))


def chunk_roles(mapped: DataFrame, *keys: str) -> DataFrame:
    return mapped.groupBy(*keys).agg(F.first("r_mass").alias("r_mass"), F.first("g_mass").alias("g_mass"), F.first("t_rg").alias("t_rg"), F.first("identifiable").alias("identifiable"), F.count("*").alias("n_atoms"))


def query_scores(roles: DataFrame, by: str) -> DataFrame:
    """The largest t_rg of each key; a key that has none, kept by an outer join, scores 0."""
    return roles.groupBy(by).agg(F.coalesce(F.max("t_rg"), F.lit(0.0)).alias("score"), F.max("identifiable").alias("identifiable"))


def top_by_mass(spans: DataFrame, by: str, chunk: str, k: int = 2) -> DataFrame:
    """The k chunks of each key with the largest sum of positive retrieval effects over spans; ties by chunk."""
    mass = spans.groupBy(by, chunk).agg(F.sum(F.greatest("r_eff", F.lit(0.0))).alias("mass"))
    return mass.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("mass"), chunk))).where(F.col("rank") <= k)


def oracle_mass(mapped: DataFrame, oracle: DataFrame, *keys: str) -> DataFrame:
    """(keys, r_oracle, g_oracle): mass inside oracle ranges; overlaps are summed, then capped at the atom's length."""
    o = oracle.select(*keys, F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    hit = mapped.join(o, list(keys)).where("o_start < end and o_end > start")
    share = hit.groupBy(*keys, "start", "end").agg(F.first("p_r").alias("p_r"), F.first("p_g").alias("p_g"), F.sum(overlap(F.col("start"), F.col("end"), F.col("o_start"), F.col("o_end"))).alias("o"))
    part = F.least(F.col("o"), F.col("end") - F.col("start")) / (F.col("end") - F.col("start"))
    found = share.groupBy(*keys).agg(F.sum(F.col("p_r") * part).alias("r"), F.sum(F.col("p_g") * part).alias("g"))
    return mapped.select(*keys).distinct().join(found, list(keys), "left").select(*keys, F.coalesce("r", F.lit(0.0)).alias("r_oracle"), F.coalesce("g", F.lit(0.0)).alias("g_oracle"))


def covered(ranges: Column) -> Column:
    """How many places an array of (start, end) covers: one sweep over the sorted ranges, each adding what it reaches beyond
    those before it."""
    whole = F.array_sort(F.transform(F.filter(ranges, lambda r: r["end"] > r["start"]), lambda r: F.struct(r["start"].cast("long").alias("start"), r["end"].cast("long").alias("end"))))
    step = lambda a, r: F.struct(F.greatest(a["upto"], r["end"]).alias("upto"), (a["n"] + F.greatest(F.lit(0).cast("long"), r["end"] - F.greatest(r["start"], a["upto"]))).alias("n"))
    return F.aggregate(whole, F.struct(F.lit(-(1 << 62)).alias("upto"), F.lit(0).cast("long").alias("n")), step, lambda a: a["n"])


def span_iou(predicted: Column, oracle: Column) -> Column:
    """Intersection over union of the characters of two arrays of ranges; 1 if both are empty. Ranges are never spelled out."""
    a, b = covered(predicted), covered(oracle)
    long = lambda ranges: F.transform(ranges, lambda r: F.struct(r["start"].cast("long").alias("start"), r["end"].cast("long").alias("end")))
    union = covered(F.concat(long(predicted), long(oracle)))
    return F.when(union == 0, 1.0).otherwise((a + b - union) / union)


def positive_total(effect: Column, name: str) -> Column:
    """The sum of positive effects; one that is not finite is an error."""
    return F.sum(F.greatest(finite(effect.cast("double"), name), F.lit(0.0)))


def donor_effects(scores: DataFrame, *keys: str, donors: int = 8) -> DataFrame:
    """Mean effects of each span over exactly `donors` replacements; another number is an error."""
    n = F.count("*")
    mean = lambda c: F.when(n == donors, F.avg(c)).otherwise(F.raise_error(F.lit(f"a span needs {donors} donors")).cast("double")).alias(c)
    return scores.groupBy(*keys, "start", "end").agg(mean("r_eff"), mean("g_eff"))


def direction(p_r: Column, p_g: Column, role: Column) -> Column:
    """Sign in which a role's mass should lean: retrieval over generation for an anchor, the reverse for a payload."""
    return F.signum(F.when(role == "anchor", p_r - p_g).otherwise(p_g - p_r)).cast("int")
