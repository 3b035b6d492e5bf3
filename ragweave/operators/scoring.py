"""From queries to scored events: retrieval, events, span effects, role maps, replacements.

Models stay outside. A scorer is a function from a frame of what is to be scored to the same keys with scores, so it may
be a join to a table of scores, an expression or a UDF:

* rerank: (query_id, chunk_id, ...) -> query_id, chunk_id, rerank_score
* hidden: spans (query_id, chunk_id, view, tok_start, start, end, span, ...) -> query_id, chunk_id, view, tok_start, dense, rerank
* teacher: the same spans -> query_id, chunk_id, view, tok_start, logp

Only spans that need a score are given to a scorer. A span that it leaves out, or a score that is not finite, is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragweave.functions import text as T
from ragweave.functions import tokens as K

from . import attribution as A
from . import retrieval as R
from .ledger import label_free, numbered

Scorer = Callable[[DataFrame], DataFrame]
CHUNK = ["query_id", "chunk_id"]
SPAN = [*CHUNK, "view", "tok_start"]
#: Columns of candidates that tell of attacks, never seen by a detector.
FORBIDDEN = {"injected", "family", "anchor", "payload", "anchor_source", "payload_source", "anchor_chunk", "payload_chunk", "target_answer", "source"}


def scored_by(scorer: Scorer, rows: DataFrame, keys: Sequence[str], *scores: str) -> DataFrame:
    """rows with the scores that the scorer gives for their keys; a missing one is null."""
    found = scorer(rows).select(*keys, *scores)
    return rows.join(found, list(keys), "left")


def retrieve(vectors: DataFrame, queries: DataFrame, rerank: Scorer, b: int, k: int, injected: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, dense_score, dense_rank, injected, rerank_score, rerank_rank, position, thresholds) of the k selected.

    vectors: (chunk_id, vec); queries: (query_id, vec); injected: (query_id, chunk_id, vec) of chunks that only their
    own query sees. The b best of both by inner product are reranked; thresholds are frozen over that pool, b and k
    bounded by its size. Ties go by chunk_id.
    """
    clean = R.dense_topk(vectors, queries, b).select("query_id", "chunk_id", F.col("score").alias("dense_score"))
    if injected is None:
        pool = R.pooled(clean, clean.limit(0), b)
    else:
        both = injected.join(queries.select("query_id", F.col("vec").alias("_q")), "query_id")
        dot = F.aggregate(F.zip_with("vec", "_q", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
        pool = R.pooled(clean, both.select("query_id", "chunk_id", dot.alias("dense_score")), b)
    pool = scored_by(rerank, pool, CHUNK, "rerank_score").withColumn("rerank_score", T.finite(F.col("rerank_score"), "rerank score"))
    return R.context(R.with_thresholds(R.reranked(pool), b, k), k)


def events(selected: DataFrame, chunks: DataFrame, queries: DataFrame, b: int, k: int) -> DataFrame:
    """(query_id, query, chunks, retrieval_trace, context_order, prompt, ranges): one label-free event for each query.

    chunks: (chunk_id, text, ...) whose other columns but FORBIDDEN ones go along; queries: (query_id, query).
    """
    shown = [c for c in chunks.columns if c not in FORBIDDEN]
    return _events(selected.join(chunks.select(*shown), "chunk_id"), shown, queries, b, k)


def _events(candidates: DataFrame, shown: list[str], queries: DataFrame, b: int, k: int) -> DataFrame:
    rows = candidates.join(queries.select("query_id", "query"), "query_id")
    trace = F.struct("position", "chunk_id", "dense_score", "dense_rank", "rerank_score", "rerank_rank", F.lit(b).alias("dense_top_b"), F.lit(k).alias("rerank_top_k"), "dense_thr", "rerank_thr")
    held = F.array_sort(F.collect_list(F.struct("position", F.struct(*shown).alias("chunk"), trace.alias("trace"))))
    made = rows.groupBy("query_id").agg(F.first("query").alias("query"), held.alias("held"))
    made = made.withColumn("_c", F.transform("held", lambda x: F.struct(x["position"].alias("position"), x["chunk"]["chunk_id"].alias("chunk"), x["chunk"]["text"].alias("text"))))
    prompt, ranges = T.prompt_of(F.col("query"), "_c")
    of = lambda f: F.transform("held", f)
    out = made.select("query_id", "query", of(lambda x: x["chunk"]).alias("chunks"), of(lambda x: x["trace"]).alias("retrieval_trace"), of(lambda x: x["chunk"]["chunk_id"]).alias("context_order"), prompt.alias("prompt"), ranges.alias("ranges"))
    return label_free(out, out.columns, FORBIDDEN)


def chunk_spans(selected: DataFrame, chunks: DataFrame, size: int = 32, offsets: Sequence[int] = (0, 16), tokenizer=None) -> DataFrame:
    """Spans of each selected chunk, with the chunk's scores and thresholds and its length.

    Only texts of selected chunks are taken apart, and whatever belongs to a chunk goes along with its text. Spans are
    persisted, since effects and scores read them again; the caller may clear the cache.
    """
    rows = selected.drop("injected").join(chunks.select("chunk_id", "text", F.length("text").alias("n_chars")), "chunk_id")
    keys = [c for c in rows.columns if c != "text"]
    return K.spans(rows, *keys, size=size, offsets=offsets, tokenizer=tokenizer).persist(StorageLevel.MEMORY_AND_DISK)


def retrieval_effects(spans: DataFrame, hidden: Scorer) -> DataFrame:
    """spans with r_eff: the margin of the whole chunk less that of the chunk without the span."""
    full = R.margin(F.col("dense_score"), F.col("rerank_score"))
    without = R.margin(F.col("dense"), F.col("rerank"))
    return scored_by(hidden, spans, SPAN, "dense", "rerank").withColumn("r_eff", A.retrieval_effect(full, without)).drop("dense", "rerank")


def generation_effects(spans: DataFrame, full: DataFrame, teacher: Scorer) -> DataFrame:
    """spans with g_eff: the answer's log-probability over the whole context (query_id, full_logp) less that without the span."""
    return scored_by(teacher, spans, SPAN, "logp").join(full, "query_id", "left").withColumn("g_eff", A.generation_effect(F.col("full_logp"), F.col("logp"))).drop("logp", "full_logp")


def role_maps(spans: DataFrame, full: DataFrame, teacher: Scorer, evaluated: DataFrame | None = None, r_floor: float = A.FLOOR, g_floor: float = A.FLOOR) -> DataFrame:
    """Atoms with their roles (see attribution.role_map) of the chunks that generation is asked for.

    spans: with r_eff. Those are the two chunks of each query with the largest positive retrieval effects, or the rows
    (query_id, chunk_id) of `evaluated`; one that is not among the spans is an error.
    """
    if evaluated is None:
        chosen = A.top_by_mass(spans, "query_id", "chunk_id").select(*CHUNK)
    else:
        known = spans.select(*CHUNK).distinct().withColumn("_known", F.lit(True))
        asked = evaluated.select(*CHUNK).distinct().join(known, CHUNK, "left")
        chosen = asked.withColumn("chunk_id", F.when(F.col("_known"), F.col("chunk_id")).otherwise(F.raise_error(F.lit("an unknown chunk is asked for")).cast(dict(spans.dtypes)["chunk_id"]))).select(*CHUNK)
    both = generation_effects(spans.join(chosen, CHUNK, "left_semi"), full, teacher)
    return A.role_map(A.atoms(both, *CHUNK), *CHUNK, r_floor=r_floor, g_floor=g_floor)


def results(mapped: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, query_score, selected_for_generation, chunks): one row for each query; one without a chunk scores 0."""
    span = F.struct("start", "end", F.col("r_eff").alias("retrieval_effect"), F.col("g_eff").alias("generation_effect"), F.col("p_r").alias("p_retrieval"), F.col("p_g").alias("p_generation"), "role")
    chunk = mapped.groupBy(*CHUNK).agg(F.first("r_mass").alias("retrieval_mass"), F.first("g_mass").alias("generation_mass"), F.first("t_rg").alias("t_rg"), F.first("identifiable").alias("role_identifiable"), F.array_sort(F.collect_list(span)).alias("spans"))
    query = chunk.groupBy("query_id").agg(F.max("t_rg").alias("query_score"), F.array_sort(F.collect_list("chunk_id")).alias("selected_for_generation"), F.array_sort(F.collect_list(F.struct("chunk_id", "retrieval_mass", "generation_mass", "t_rg", "role_identifiable", "spans"))).alias("chunks"))
    out = queries.select("query_id").distinct().join(query, "query_id", "left")
    return out.withColumn("query_score", F.coalesce("query_score", F.lit(0.0))).withColumn("selected_for_generation", F.coalesce("selected_for_generation", F.array().cast(dict(query.dtypes)["selected_for_generation"])))


def score_events(event: DataFrame, candidates: DataFrame, full: DataFrame, hidden: Scorer, teacher: Scorer, **options) -> DataFrame:
    """Atoms with roles of each event, from label-free candidates (query_id, chunk_id, text, scores, thresholds).

    A forbidden column, or candidates that are not exactly those of the event's context, are an error. Spans and their
    effects, those of the k selected chunks of each query, are persisted; the caller may clear the cache.
    """
    label_free(candidates, candidates.columns, FORBIDDEN)
    wanted = event.select("query_id", F.explode("context_order").alias("chunk_id")).withColumn("_e", F.lit(True))
    both = wanted.join(candidates.withColumn("_c", F.lit(True)), CHUNK, "full_outer")
    same = F.col("_e").isNotNull() & F.col("_c").isNotNull()
    checked = both.withColumn("chunk_id", F.when(same, F.col("chunk_id")).otherwise(F.raise_error(F.lit("candidates do not match the event")).cast(dict(candidates.dtypes)["chunk_id"]))).drop("_e", "_c")
    floors = {k: options.pop(k) for k in ("r_floor", "g_floor") if k in options}
    views = K.spans(checked, *CHUNK, **options)
    spans = checked.withColumn("n_chars", F.length("text")).drop("text").join(views, CHUNK)
    # the choice of chunks, the scores asked for and the maps all read the effects
    effects = retrieval_effects(spans.persist(StorageLevel.MEMORY_AND_DISK), hidden).persist(StorageLevel.MEMORY_AND_DISK)
    return role_maps(effects, full, teacher, **floors)


def score_chunks(spans: DataFrame, full: DataFrame, teacher: Scorer, evaluated: DataFrame, **floors) -> DataFrame:
    """role_maps() of the chunks asked for; for evaluation with known ranges, never for detection."""
    return role_maps(spans, full, teacher, evaluated, **floors)


def no_op_deltas(first: DataFrame, again: DataFrame) -> DataFrame:
    """(query_id, chunk_id, retrieval_delta, generation_delta) of two runs over unaltered texts.

    Both: (query_id, chunk_id, dense_score, rerank_score, logp), and thresholds in the first.
    """
    second = again.select(*CHUNK, F.col("dense_score").alias("_d"), F.col("rerank_score").alias("_r"), F.col("logp").alias("_l"))
    both = first.join(second, CHUNK, "left")
    moved = A.retrieval_effect(R.margin(F.col("dense_score"), F.col("rerank_score")), R.margin(F.col("_d"), F.col("_r")))
    return both.select(*CHUNK, F.abs(moved).alias("retrieval_delta"), F.abs(A.generation_effect(F.col("logp"), F.col("_l"))).alias("generation_delta"))


def score_donors(spans: DataFrame, donors: DataFrame, full: DataFrame, replaced: Scorer, n: int = 8, **floors) -> DataFrame:
    """Atoms with roles from replacements instead of hiding: each span meets `n` donors and its effects are their means.

    donors: (query_id, donor_id, donor); replaced: spans with donors -> SPAN, donor_id, dense, rerank, logp. A query
    with another number of donors is an error.
    """
    each = spans.join(donors, "query_id")
    found = scored_by(replaced, each, [*SPAN, "donor_id"], "dense", "rerank", "logp").join(full, "query_id", "left")
    full_margin, margin = R.margin(F.col("dense_score"), F.col("rerank_score")), R.margin(F.col("dense"), F.col("rerank"))
    effects = found.withColumn("r_eff", A.retrieval_effect(full_margin, margin)).withColumn("g_eff", A.generation_effect(F.col("full_logp"), F.col("logp")))
    mean = A.donor_effects(effects, *SPAN, donors=n)
    return A.role_map(A.atoms(mean, *CHUNK), *CHUNK, **floors)


def oracle_values(mapped: DataFrame, anchor: DataFrame, payload: DataFrame, *keys: str) -> DataFrame:
    """(keys, anchor_p_retrieval, anchor_p_generation, payload_p_retrieval, payload_p_generation) inside known ranges."""
    parts = [A.oracle_mass(mapped, r, *keys).select(*keys, F.col("r_oracle").alias(f"{name}_p_retrieval"), F.col("g_oracle").alias(f"{name}_p_generation")) for name, r in (("anchor", anchor), ("payload", payload))]
    return parts[0].join(parts[1], list(keys))


def score_queries(vectors: DataFrame, queries: DataFrame, chunks: DataFrame, rerank: Scorer, hidden: Scorer, teacher: Scorer, full: Callable[[DataFrame], DataFrame], b: int, k: int, injected: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, atoms, events): one call from queries (query_id, query, vec) and indexed chunks to scored events.

    full: from events to (query_id, full_logp), the answer's log-probability over the whole context. The selected chunks,
    k for each query, are persisted, since events, spans and scores all read them; the caller may clear the cache.
    """
    shown = [c for c in chunks.columns if c not in FORBIDDEN]
    selected = retrieve(vectors, queries, rerank, b, k, injected).drop("injected")
    candidates = selected.join(chunks.select(*shown), "chunk_id").persist(StorageLevel.MEMORY_AND_DISK)
    event = _events(candidates, shown, queries, b, k)
    mapped = score_events(event, candidates.select(*selected.columns, "text"), full(event), hidden, teacher, **options).persist(StorageLevel.MEMORY_AND_DISK)
    return results(mapped, queries), mapped, event


def pilot(results_: DataFrame) -> DataFrame:
    """results() of a trial run, with every chunk's t_rg checked to lie between 0 and 1."""
    bad = F.exists("chunks", lambda c: c["t_rg"].isNull() | (c["t_rg"] < 0) | (c["t_rg"] > 1))
    return results_.withColumn("query_score", F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("a separation score is out of range")).cast("double")).otherwise(F.col("query_score")))


def sliced(rows: DataFrame, by: str, start: int, limit: int) -> DataFrame:
    """Rows start to start + limit in the order of `by` as text ("test10" before "test2")."""
    return rows.orderBy(F.col(by).cast("string")).offset(start).limit(limit)


def in_shard(rows: DataFrame, order: str, shard: int, shards: int) -> DataFrame:
    """Rows whose place, by `order`, leaves `shard` when divided by `shards`; places are numbered range by range."""
    if not 0 <= shard < shards:
        raise ValueError("a shard must be at least 0 and below their number")
    return numbered(rows, order, "_at").where(F.pmod("_at", F.lit(shards)) == shard).drop("_at")


