"""Rates, group summaries, gates and boundary judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import cluster_bootstrap_by, conformal_pvalues, flagged, holm, quantile, sign_flip_by, with_interval


def attack_metrics(rows: DataFrame) -> DataFrame:
    """One row from (hit, success): hit_rate, conditional (0 without hits), end_to_end, n, n_hits."""
    n, hits, both = F.count("*"), F.count_if("hit"), F.count_if(F.col("hit") & F.col("success"))
    return rows.agg((hits / n).alias("hit_rate"), F.when(hits == 0, 0.0).otherwise(both / hits).alias("conditional"), (both / n).alias("end_to_end"), n.alias("n"), hits.alias("n_hits"))


def group_summary(rows: DataFrame, *by: str, alpha: float = 0.05, interval: bool = True) -> DataFrame:
    """Per group of (flag, identifiable): n, flagged, rate, identifiable_rate and an exact interval."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("flag").alias("k"), F.avg(F.col("identifiable").cast("double")).alias("identifiable_rate"))
    out = out.withColumn("rate", F.col("k") / F.col("n"))
    return with_interval(out, alpha=alpha) if interval else out


def conformal_detector(calibration: DataFrame, clean: DataFrame, attack: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Clean and attack rows with p and flag; each part must have rows."""
    parts = [d.withColumn("part", F.lit(p)).withColumn("is_cal", F.lit(p == "calibration")) for p, d in (("calibration", calibration), ("clean", clean), ("attack", attack))]
    for p in parts:
        if p.isEmpty():
            raise ValueError("calibration, clean and attack rows are needed")
    scored = conformal_pvalues(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return scored.withColumn("flag", flagged(F.col("p"), alpha)).drop("is_cal")


def detector_summaries(tested: DataFrame, interval: bool = True) -> DataFrame:
    """Overall rows by part and rows by family of attacks, from one grouping-sets aggregate."""
    sets = tested.groupingSets([["part"], ["part", "family"]], "part", "family")
    rate = F.count_if("flag") / F.count("*").cast("double")
    out = sets.agg(F.count("*").alias("n"), F.count_if("flag").alias("k"), F.avg(F.col("identifiable").cast("double")).alias("identifiable_rate"), rate.alias("rate"), F.grouping("family").alias("_all")).where("_all = 1 or part = 'attack'").drop("_all")
    return with_interval(out) if interval else out


def direction_stability(rows: DataFrame, rate: float = 0.80, low: float = 0.70) -> DataFrame:
    """Per role of (role, mask_direction, donor_direction): agreement of equal non-zero signs and whether it suffices.

    Both roles must have rows.
    """
    if {r[0] for r in rows.select("role").distinct().limit(3).collect()} < {"anchor", "payload"}:
        raise ValueError("anchor and payload rows are needed")
    same = (F.col("mask_direction") == F.col("donor_direction")) & (F.col("mask_direction") != 0)
    out = with_interval(rows.groupBy("role").agg(F.count("*").alias("n"), F.count_if(same).alias("k")))
    return out.withColumn("rate", F.col("k") / F.col("n")).withColumn("passed", (F.col("k") / F.col("n") >= rate) & (F.col("ci_low") >= low))


def boundary(scores: DataFrame) -> DataFrame:
    """One row from (kind in clean, modular, joint; score, identifiable): medians, persists, weakened."""
    kinds = [quantile(scores.where(F.col("kind") == k), "score", 0.5, k) for k in ("clean", "modular", "joint")]
    rate = scores.agg(F.avg(F.when(F.col("kind") == "joint", F.col("identifiable").cast("double"))).alias("joint_identifiable"))
    out = kinds[0].crossJoin(kinds[1]).crossJoin(kinds[2]).crossJoin(rate)  # one row each
    return out.withColumn("persists", (F.col("joint") > F.col("clean")) & (F.col("joint_identifiable") >= 0.5)).withColumn("weakened", F.col("joint") < F.col("modular"))


def noise_floor(rows: DataFrame, least: float = 1e-8, q: float = 0.99) -> DataFrame:
    """Quantile of positive totals by channel, and their maxima; the floors are never below `least`."""
    floors = [quantile(rows, f"{c}_total", q, f"{c}_floor").withColumn(f"{c}_floor", F.greatest(F.lit(least), f"{c}_floor")) for c in ("retrieval", "generation")]
    top = rows.agg(F.max("retrieval_total").alias("retrieval_max"), F.max("generation_total").alias("generation_max"))
    return floors[0].crossJoin(floors[1]).crossJoin(top)  # one row each


def mechanism_tests(observations: DataFrame, permutations: int = 10000, replicates: int = 10000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(name, n, clusters, median_difference, p, ci_low, ci_high, p_adj, passes) of the three paired hypotheses.

    observations: (query_id, anchor_p_retrieval, anchor_p_generation, payload_p_retrieval, payload_p_generation,
    poison_t_rg, clean_t_rg). H1: anchors lean to retrieval, H2: payloads to generation, H3: poisoned chunks separate
    more than clean ones. Each is one sample of differences with generators of its own seed, whose draws are dealt to
    tasks; they follow the order of query_id and difference. passes: p_adj below alpha and an interval above 0.
    """
    differences = {"H1": F.col("anchor_p_retrieval") - F.col("anchor_p_generation"), "H2": F.col("payload_p_generation") - F.col("payload_p_retrieval"), "H3": F.col("poison_t_rg") - F.col("clean_t_rg")}
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), d.alias("d")) for k, d in differences.items())))
    long = observations.select(F.col("query_id").cast("string").alias("query_id"), pairs.alias("x")).select("query_id", "x.*")
    seeds = {k: seed + i for i, k in enumerate(differences)}
    tests = long.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("clusters"), F.percentile("d", F.lit(0.5)).alias("median_difference"))
    tests = tests.join(sign_flip_by(long, "name", "d", permutations, seeds, cluster="query_id"), "name")
    tests = tests.join(cluster_bootstrap_by(long, "name", "query_id", "d", replicates, alpha, {k: 100 + v for k, v in seeds.items()}), "name")
    return holm(tests).withColumn("passes", (F.col("p_adj") < alpha) & (F.col("ci_low") > 0))


def mechanism_gate(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: whether every test of (p_adj, ci_low) has p_adj below alpha and an interval above 0."""
    return tests.agg(F.bool_and((F.col("p_adj") < alpha) & (F.col("ci_low") > 0)).alias("passed"))


#: The states with which a component passes.
PASSING = ["PASS_EXACT", "PASS_FUNCTIONAL"]


def audit_status(checked: Column, failed: Column, least: int = 20) -> Column:
    """FAIL with any failure, PASS_FUNCTIONAL from `least` checks on, WARN with fewer."""
    return F.when(failed > 0, "FAIL").when(checked >= least, "PASS_FUNCTIONAL").otherwise("WARN")


def audit_decision(components: DataFrame, required: list[str], informational: list[str] = ()) -> DataFrame:
    """One row from (name, status): PASS if every required component passes, and a reason for each that was named.

    No required component, one that is named twice or in both lists, and one that components do not have are errors.
    """
    named = [*required, *informational]
    if not required:
        raise ValueError("an audit needs a required component")
    if len(set(required)) < len(required) or len(set(informational)) < len(informational):
        raise ValueError("a component is named twice")
    if set(required) & set(informational):
        raise ValueError("a component is both required and informational")
    asked = components.sparkSession.createDataFrame([(n, i, i < len(required)) for i, n in enumerate(named)], "name string, place int, required boolean")
    rows = asked.join(components.select("name", "status"), "name", "left")
    known = F.when(F.col("status").isNull(), F.raise_error(F.concat(F.lit("unknown component: "), "name")).cast("string")).otherwise(F.col("status"))
    rows = rows.withColumn("status", known)
    reason = F.concat("name", F.lit(": "), "status", F.when(F.col("required"), "").otherwise(", informational"))
    reasons = F.transform(F.array_sort(F.collect_list(F.struct("place", reason.alias("reason")))), lambda x: x["reason"])
    return rows.agg(F.when(F.bool_and(~F.col("required") | F.col("status").isin(*PASSING)), "PASS").otherwise("FAIL").alias("decision"), reasons.alias("reasons"))


def compared_runs(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per key whether two runs agree on every column, nulls included; keys of one run only don't."""
    both = a.alias("a").join(b.alias("b"), key, "full_outer")
    same = F.col(f"a.{columns[0]}").eqNullSafe(F.col(f"b.{columns[0]}"))
    for c in columns[1:]:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return both.select(key, same.alias("exact"))


def lineage_errors(chunks: DataFrame, docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """(by, chunk_no, bad_text, bad_range, bad_tokens) of chunks that do not stand where they say; none if all do.

    A chunk's text must be what its document has at its place, its token range must not be empty, and the text must
    have as many tokens of its own as the range.
    """
    source = docs.select(by, F.col(text).alias("__source"))
    both = chunks.join(source, by)
    there = F.substring(F.col("__source"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    count = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    checked = both.select(by, "chunk_no", (there != F.col("text")).alias("bad_text"), (F.col("tok_end") <= F.col("tok_start")).alias("bad_range"), (count != F.col("tok_end") - F.col("tok_start")).alias("bad_tokens"))
    return checked.where("bad_text or bad_range or bad_tokens")


def final_verdict(gates: DataFrame) -> DataFrame:
    """One row from (gate, passed), the two judgments as gates `weakened` and `persists`, and `run`: what to do next, and why.

    An early gate or the mechanism gate that failed ends the work, robustness that failed narrows it; then the joint
    judgments decide. Without them, a run that passed as a whole goes on with caution, as its boundary was not measured.
    A gate without a row or with a null was not reached.
    """
    found = gates.agg(*(F.bool_and(F.when(F.col("gate") == g, F.col("passed"))).alias(g) for g in ("audit", "determinism", "mechanism", "robustness", "weakened", "persists", "run")))
    failed = lambda g: F.col(g).eqNullSafe(False)
    verdict = F.when(failed("audit") | failed("determinism") | failed("mechanism"), "terminate").when(failed("robustness") | F.col("weakened"), "narrow").when(F.col("persists"), "continue").when(F.col("run"), "continue with caution").otherwise("open")
    why = F.when(failed("audit"), "audit").when(failed("determinism"), "determinism").when(failed("mechanism"), "mechanism").when(failed("robustness"), "robustness").when(F.col("weakened"), "weakened").when(F.col("persists"), "persists").when(F.col("run"), "run")
    return found.select(verdict.alias("verdict"), why.alias("reason"))
