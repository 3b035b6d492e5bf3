"""Queries over the tables, each beside SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ragweave.functions import text as T
from ragweave.functions import tokens as K
from ragweave.operators import attribution as A
from ragweave.operators import evaluate as E
from ragweave.operators import ledger as L
from ragweave.operators import retrieval as R
from ragweave.operators import scoring as C
from ragweave.operators import stats as S
from ragweave.operators import tasks as X
from ragweave.sources import provenance as PR

SIZE, OVERLAP = 64, 8


def _read(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _round(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    return df.select(*(F.round(c, n).alias(c) if c in cols else F.col(c) for c in df.columns))


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_TOK = r"""
parts AS (SELECT doc_id, unnest(regexp_extract_all(text, '\s*\S+')) AS part, generate_subscripts(regexp_extract_all(text, '\s*\S+'), 1) - 1 AS token_index FROM documents),
placed AS (SELECT doc_id, token_index, regexp_extract(part, '\S+') AS token, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY token_index) AS char_end FROM parts),
tokens AS (SELECT doc_id, CAST(token_index AS INTEGER) AS token_index, token, CAST(char_end - length(token) AS INTEGER) AS char_start, CAST(char_end AS INTEGER) AS char_end FROM placed)"""
_CHUNK = f"""{_TOK},
counted AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
starts AS (SELECT doc_id, n, k, k * {SIZE - OVERLAP} AS s FROM (SELECT doc_id, n, unnest(range(n)) AS k FROM counted) WHERE k * {SIZE - OVERLAP} < n AND (k = 0 OR (k - 1) * {SIZE - OVERLAP} + {SIZE} < n)),
chunks AS (SELECT t.doc_id, CAST(k AS INTEGER) AS chunk_no, CAST(min(token_index) AS INTEGER) AS tok_start, CAST(max(token_index) + 1 AS INTEGER) AS tok_end, min(char_start) AS char_start, max(char_end) AS char_end
  FROM starts JOIN tokens t ON t.doc_id = starts.doc_id AND token_index >= s AND token_index < s + {SIZE} GROUP BY t.doc_id, k)"""
#: A stand-in for model scores, so that plans can run without models: effects from shares of short and of long tokens.
_SPAN = f"""{_CHUNK},
views AS (SELECT doc_id, chunk_no, tok_start, tok_end, v, v + 32 * j AS s, least(v + 32 * j + 32, tok_end - tok_start) AS e
  FROM (SELECT *, unnest([0, 16]) AS v FROM chunks) x, (SELECT unnest(range(2)) AS j) y WHERE v + 32 * j < tok_end - tok_start),
spans AS (SELECT views.doc_id, chunk_no, v, s, min(char_start) AS "start", max(char_end) AS "end",
    (sum(CASE WHEN length(token) <= 3 THEN 1 ELSE 0 END) - 8) / 8e0 AS r_eff, (sum(CASE WHEN length(token) > 6 THEN 1 ELSE 0 END) - 6) / 8e0 AS g_eff
  FROM views JOIN tokens t ON t.doc_id = views.doc_id AND token_index >= tok_start + s AND token_index < tok_start + e GROUP BY ALL)"""
_ATOM = f"""{_SPAN},
pts AS (SELECT DISTINCT doc_id, chunk_no, p FROM (SELECT doc_id, chunk_no, "start" AS p FROM spans UNION ALL SELECT doc_id, chunk_no, "end" FROM spans)),
gaps AS (SELECT doc_id, chunk_no, p AS a, lead(p) OVER (PARTITION BY doc_id, chunk_no ORDER BY p) AS b FROM pts),
atoms AS (SELECT g.doc_id, g.chunk_no, a AS "start", b AS "end", avg(r_eff) AS r_eff, avg(g_eff) AS g_eff FROM gaps g JOIN spans s ON g.doc_id = s.doc_id AND g.chunk_no = s.chunk_no AND s."start" < b AND s."end" > a WHERE b IS NOT NULL GROUP BY ALL)"""
_ROLE = f"""{_ATOM},
mass AS (SELECT *, sum(greatest(r_eff, 0)) OVER w AS r_mass, sum(greatest(g_eff, 0)) OVER w AS g_mass FROM atoms WINDOW w AS (PARTITION BY doc_id, chunk_no)),
share AS (SELECT *, r_mass > 1e-8 AND g_mass > 1e-8 AS identifiable, CASE WHEN r_mass > 1e-8 AND g_mass > 1e-8 THEN greatest(r_eff, 0) / r_mass ELSE 0 END AS p_r, CASE WHEN r_mass > 1e-8 AND g_mass > 1e-8 THEN greatest(g_eff, 0) / g_mass ELSE 0 END AS p_g FROM mass),
roles AS (SELECT doc_id, chunk_no, first(r_mass) AS r_mass, first(g_mass) AS g_mass, first(identifiable) AS identifiable, least(1, 0.5e0 * sum(abs(p_r - p_g))) AS t_rg, count(*) AS n_atoms FROM share GROUP BY doc_id, chunk_no)"""


@query("token_offsets", f"WITH {_TOK} SELECT * FROM tokens")
def token_offsets(spark, d):
    return K.token_offsets(_read(spark, d, "documents"))


def _chunks(spark, d):
    return K.chunks(_read(spark, d, "documents"), SIZE, OVERLAP)


@query("chunk_windows", f"""WITH {_CHUNK}, h AS (SELECT sha256('{{"chunk_size": {SIZE}, "overlap": {OVERLAP}, "tokenizer": "whitespace"}}') AS hash)
SELECT c.doc_id, chunk_no, tok_start, tok_end, char_start, char_end, sha256(substr(text, char_start + 1, char_end - char_start)) AS text_hash, substr(sha256(concat_ws(':', c.doc_id, tok_start, tok_end, hash)), 1, 24) AS chunk_id FROM chunks c JOIN documents USING (doc_id), h""")
def chunk_windows(spark, d):
    return _chunks(spark, d).withColumn("text_hash", F.sha2("text", 256)).drop("text", "chunker_hash")


@query("chunk_lineage_violations", f"""WITH {_CHUNK}, kept AS (SELECT c.*, substr(text, char_start + 1, char_end - char_start) AS chunk_text, text FROM chunks c JOIN documents USING (doc_id)),
moved AS (SELECT doc_id, chunk_no, chunk_text, text, char_start, CASE WHEN doc_id % 7 = 0 THEN char_end - 1 ELSE char_end END AS char_end, tok_start, CASE WHEN doc_id % 11 = 0 THEN tok_end + 1 WHEN doc_id % 13 = 0 THEN tok_start ELSE tok_end END AS tok_end FROM kept)
SELECT doc_id, chunk_no, substr(text, char_start + 1, char_end - char_start) <> chunk_text AS bad_text, tok_end <= tok_start AS bad_range, len(regexp_extract_all(chunk_text, '\\S+')) <> tok_end - tok_start AS bad_tokens FROM moved WHERE bad_text OR bad_range OR bad_tokens""")
def chunk_lineage_violations(spark, d):
    """Chunks of which some are moved on purpose: every seventh document's ends, every eleventh's and thirteenth's tokens."""
    moved = _chunks(spark, d).withColumn("char_end", F.when(F.col("doc_id") % 7 == 0, F.col("char_end") - 1).otherwise(F.col("char_end"))).withColumn("tok_end", F.when(F.col("doc_id") % 11 == 0, F.col("tok_end") + 1).when(F.col("doc_id") % 13 == 0, F.col("tok_start")).otherwise(F.col("tok_end")))
    return E.lineage_errors(moved, _read(spark, d, "documents"), "doc_id")


def _spans(spark, d) -> DataFrame:
    """Spans of chunks, in places of the document, with stand-in effects from the lengths of their tokens."""
    each = K.chunk_spans(_read(spark, d, "documents"), SIZE, OVERLAP, lengths=(3, 6))
    r_eff, g_eff = (F.col("n_upto_3") - 8) / F.lit(8.0), (F.col("n") - F.col("n_upto_6") - 6) / F.lit(8.0)
    return each.select("doc_id", "chunk_no", F.col("view").alias("v"), F.col("tok_start").alias("s"), "start", "end", r_eff.alias("r_eff"), g_eff.alias("g_eff"))


@query("span_views", f'WITH {_SPAN} SELECT doc_id, chunk_no, CAST(v AS INTEGER) AS v, CAST(s AS INTEGER) AS s, "start", "end", r_eff, g_eff FROM spans')
def span_views(spark, d):
    return _spans(spark, d)


@query("span_atoms", f'WITH {_ATOM} SELECT doc_id, chunk_no, "start", "end", round(r_eff, 6) AS r_eff, round(g_eff, 6) AS g_eff FROM atoms')
def span_atoms(spark, d):
    return _round(A.atoms(_spans(spark, d), "doc_id", "chunk_no"), "r_eff", "g_eff")


def _mapped(spark, d):
    return A.role_map(A.atoms(_spans(spark, d), "doc_id", "chunk_no"), "doc_id", "chunk_no")


@query("role_map", f"WITH {_ROLE} SELECT doc_id, chunk_no, round(r_mass, 6) AS r_mass, round(g_mass, 6) AS g_mass, round(t_rg, 6) AS t_rg, identifiable, n_atoms FROM roles")
def role_map(spark, d):
    return _round(A.chunk_roles(_mapped(spark, d), "doc_id", "chunk_no"), "r_mass", "g_mass", "t_rg")


@query("doc_role_score", f"WITH {_ROLE} SELECT doc_id, round(max(t_rg), 6) AS score, bool_or(identifiable) AS identifiable FROM roles GROUP BY doc_id")
def doc_role_score(spark, d):
    return _round(A.query_scores(A.chunk_roles(_mapped(spark, d), "doc_id", "chunk_no"), "doc_id"), "score")


@query("oracle_mass", f"""WITH {_ROLE} SELECT doc_id, chunk_no, round(sum(p_r * greatest(0, least("end", o + 60) - greatest("start", o)) / ("end" - "start")), 6) AS r_oracle, round(sum(p_g * greatest(0, least("end", o + 60) - greatest("start", o)) / ("end" - "start")), 6) AS g_oracle
FROM (SELECT *, min("start") OVER (PARTITION BY doc_id, chunk_no) AS o FROM share) GROUP BY ALL""")
def oracle_mass(spark, d):
    m = _mapped(spark, d)
    o = m.groupBy("doc_id", "chunk_no").agg(F.min("start").alias("start")).withColumn("end", F.col("start") + 60)
    return _round(A.oracle_mass(m, o, "doc_id", "chunk_no"), "r_oracle", "g_oracle")


@query("top2_positive_mass", f"WITH {_SPAN}, m AS (SELECT doc_id, chunk_no, sum(greatest(r_eff, 0)) AS mass FROM spans GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mass DESC, chunk_no) AS rank FROM m) SELECT doc_id, chunk_no, mass, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2")
def top2_positive_mass(spark, d):
    return A.top_by_mass(_spans(spark, d), "doc_id", "chunk_no")


_VEC = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), c AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS v, label FROM embeddings),
s AS (SELECT query_id, chunk_id, label, list_dot_product(q.v, c.v) AS x FROM q, c),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 12) DESC, chunk_id) AS rank FROM s QUALIFY rank <= 20),
pool AS (SELECT query_id, chunk_id, round(x, 6) AS dense_score, rank AS dense_rank, round(round(x, 6) * ((chunk_id * 37) % 11 - 3) / 7e0, 6) AS rerank_score FROM dense)"""


def _pool(spark, d):
    e = _read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    top = R.dense_topk(e, e.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id"), 20)
    return top.select("query_id", "chunk_id", F.round("score", 6).alias("dense_score"), F.col("rank").alias("dense_rank"), F.round(F.round("score", 6) * ((F.col("chunk_id") * 37) % 11 - 3) / F.lit(7.0), 6).alias("rerank_score"))


@query("dense_topk", f"WITH {_VEC} SELECT query_id, chunk_id, dense_score, CAST(dense_rank AS INTEGER) AS dense_rank FROM pool")
def dense_topk(spark, d):
    return _pool(spark, d).drop("rerank_score")


_NAMED = """v AS (SELECT 'é' || vec_id AS chunk_id, vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT 'q' || q.vec_id AS query_id, v.chunk_id, list_dot_product(q.v, v.v) AS x FROM v q, v WHERE q.vec_id % 3 = 0)"""


@query("named_topk", f"WITH {_NAMED} SELECT query_id, chunk_id, round(x, 6) AS dense_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(x, 12) DESC, chunk_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10")
def named_topk(spark, d):
    """The ten best of all vectors for every third one, both by name."""
    e = _read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    name = lambda head: F.concat(F.lit(head), F.col("vec_id").cast("string"))
    top = R.dense_topk(e.select(name("é").alias("chunk_id"), "vec"), e.where("vec_id % 3 = 0").select(name("q").alias("query_id"), "vec"), 10)
    return top.select("query_id", "chunk_id", F.round("score", 6).alias("dense_score"), "rank")


@query("rerank_two_stage", f"WITH {_VEC}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rerank_rank FROM pool) SELECT query_id, chunk_id, rerank_score, CAST(rerank_rank AS INTEGER) AS rerank_rank, CAST(rerank_rank - 1 AS INTEGER) AS position FROM r WHERE rerank_rank <= 5")
def rerank_two_stage(spark, d):
    return R.context(R.reranked(_pool(spark, d)), 5).select("query_id", "chunk_id", "rerank_score", "rerank_rank", "position")


_THR = f"""{_VEC}, m AS (SELECT query_id, median(dense_score) AS dm, median(rerank_score) AS rm, list_sort(list(dense_score), 'DESC')[20] AS dense_thr, list_sort(list(rerank_score), 'DESC')[5] AS rerank_thr FROM pool GROUP BY query_id),
thr AS (SELECT query_id, first(dense_thr) AS dense_thr, first(rerank_thr) AS rerank_thr, greatest(1e-8, median(abs(dense_score - dm))) AS dense_mad, greatest(1e-8, median(abs(rerank_score - rm))) AS rerank_mad FROM pool JOIN m USING (query_id) GROUP BY query_id)"""


@query("frozen_thresholds", f"WITH {_THR} SELECT query_id, dense_thr, rerank_thr, round(dense_mad, 9) AS dense_mad, round(rerank_mad, 9) AS rerank_mad FROM thr")
def frozen_thresholds(spark, d):
    return _round(R.frozen_thresholds(_pool(spark, d), 20, 5), "dense_mad", "rerank_mad", n=9)


@query("pipeline_margin", f"WITH {_THR} SELECT query_id, chunk_id, round(least((dense_score - dense_thr) / dense_mad, (rerank_score - rerank_thr) / rerank_mad), 7) AS margin FROM pool JOIN thr USING (query_id)")
def pipeline_margin(spark, d):
    p = _pool(spark, d)
    return p.join(R.frozen_thresholds(p, 20, 5), "query_id").select("query_id", "chunk_id", F.round(R.margin(F.col("dense_score"), F.col("rerank_score")), 7).alias("margin"))


def _parts(spark, d):
    e = _read(spark, d, "events").select("event_id", F.col("value").alias("score"), F.col("event_type").alias("family"), (F.col("event_id") % 3).alias("k"))
    return e.withColumn("identifiable", F.col("event_id") % 7 != 0)


_CONF = """cal AS (SELECT value AS score FROM events WHERE event_id % 3 = 0 AND value IS NOT NULL), n AS (SELECT count(*) AS n FROM cal),
tested AS (SELECT event_id, value AS score, event_type AS family, event_id % 3 AS k, event_id % 7 <> 0 AS identifiable, (1 + (SELECT count(*) FROM cal WHERE cal.score >= events.value)) / (n + 1)::DOUBLE AS p FROM events, n WHERE event_id % 3 > 0 AND value IS NOT NULL)"""


def _tested(spark, d):
    e = _parts(spark, d).where("score is not null")
    return E.conformal_detector(e.where("k = 0"), e.where("k = 1"), e.where("k = 2"))


@query("conformal_pvalues", f"WITH {_CONF} SELECT event_id, round(p, 9) AS p, p <= 0.05 AS flag FROM tested")
def conformal_pvalues(spark, d):
    return _tested(spark, d).select("event_id", F.round("p", 9).alias("p"), "flag")


@query("conformal_groups", f"WITH {_CONF}, t AS (SELECT *, CASE k WHEN 1 THEN 'clean' ELSE 'attack' END AS part, p <= 0.05 AS flag FROM tested) SELECT part, family, count(*) AS n, count_if(flag)::BIGINT AS k, round(avg(identifiable::INTEGER), 9) AS identifiable_rate, round(count_if(flag) / count(*)::DOUBLE, 9) AS rate FROM t GROUP BY GROUPING SETS ((part), (part, family)) HAVING grouping(family) = 1 OR part = 'attack'")
def conformal_groups(spark, d):
    return _round(E.detector_summaries(_tested(spark, d), interval=False), "identifiable_rate", "rate", n=9)


@query("clopper_pearson")
def clopper_pearson(spark, d):
    return E.group_summary(_parts(spark, d).withColumn("flag", F.col("event_id") % 10 == 0), "family")


@query("holm_adjust", "WITH t AS (SELECT user_id AS name, count_if(event_type = 'click') / (count(*) + 1)::DOUBLE AS p FROM events WHERE user_id IS NOT NULL GROUP BY user_id), s AS (SELECT name, p, least(1, p * (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1)) AS s FROM t) SELECT name, round(p, 9) AS p, round(max(s) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 9) AS p_adj FROM s")
def holm_adjust(spark, d):
    t = _read(spark, d, "events").where("user_id is not null").groupBy(F.col("user_id").alias("name")).agg((F.count_if(F.col("event_type") == "click") / (F.count("*") + 1).cast("double")).alias("p"))
    return _round(S.holm(t), "p", "p_adj", n=9)


#: Signs of 10,000 draws: draw k from 1 is bit (k - 1) % 28 of one of the four numbers of 28 bits that an md5 gives.
_SIGNS = """h AS (SELECT event_id, value, q, md5(q || ':' || event_id) AS h FROM events, (SELECT unnest(range(90)) AS q) WHERE value IS NOT NULL),
x AS (SELECT value, 4 * q + p AS j, ('0x' || substr(h, 1 + 7 * p::INTEGER, 7))::BIGINT AS x FROM h, (SELECT unnest(range(4)) AS p) WHERE 4 * q + p < 358),
d AS (SELECT 28 * j + i + 1 AS k, CASE WHEN x & (1::BIGINT << i::INTEGER) = 0 THEN value ELSE -value END AS v FROM x, (SELECT unnest(range(28)) AS i) WHERE 28 * j + i < 10000)"""


@query("sign_flip_hash", f"WITH {_SIGNS}, s AS (SELECT k, round(sum(v), 6) AS s FROM d GROUP BY k), o AS (SELECT round(sum(value), 6) AS observed FROM events) SELECT observed, (count_if(s >= observed) + 1) / 10001e0 AS p FROM s, o GROUP BY observed")
def sign_flip_hash(spark, d):
    return S.sign_flip_hash(_read(spark, d, "events").where("value is not null"), "event_id", "value")


@query("sign_flip_numpy")
def sign_flip_numpy(spark, d):
    return S.sign_flip_by(_read(spark, d, "events").where("value is not null").withColumn("d", F.col("value") - 5), "event_type", "d", 10000, 7)


@query("noise_floor_q99", "SELECT round(greatest(1e-8, quantile_cont(r, 0.99)), 6) AS retrieval_floor, round(greatest(1e-8, quantile_cont(g, 0.99)), 6) AS generation_floor, round(max(r), 6) AS retrieval_max, round(max(g), 6) AS generation_max FROM (SELECT user_id, sum(greatest(value, 0)) AS r, sum(greatest(value - 5, 0)) AS g FROM events GROUP BY user_id)")
def noise_floor_q99(spark, d):
    e = _read(spark, d, "events").groupBy("user_id").agg(A.positive_total(F.coalesce("value", F.lit(0.0)), "retrieval effect").alias("retrieval_total"), A.positive_total(F.coalesce(F.col("value") - 5, F.lit(0.0)), "generation effect").alias("generation_total"))
    return _round(E.noise_floor(e), "retrieval_floor", "generation_floor", "retrieval_max", "generation_max")


@query("attack_metrics", "SELECT count_if(quality = 1) / count(*)::DOUBLE AS hit_rate, count_if(quality = 1 AND toxic = 1) / count_if(quality = 1)::DOUBLE AS conditional, count_if(quality = 1 AND toxic = 1) / count(*)::DOUBLE AS end_to_end, count(*) AS n, count_if(quality = 1)::BIGINT AS n_hits FROM labels")
def attack_metrics(spark, d):
    return E.attack_metrics(_read(spark, d, "labels").select((F.col("quality") == 1).alias("hit"), (F.col("toxic") == 1).alias("success")))


@query("ledger_first_wins", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def ledger_first_wins(spark, d):
    return L.first_wins(_read(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


_QUOTA = {"click": 40, "purchase": 25, "signup": 1000000}


def _quotas(spark):
    return spark.createDataFrame(list(_QUOTA.items()), "event_type string, quota int")


@query("quota_topn", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events) WHERE n <= CASE event_type WHEN 'click' THEN 40 WHEN 'purchase' THEN 25 WHEN 'signup' THEN 1000000 ELSE 0 END")
def quota_topn(spark, d):
    return L.within_quota(_read(spark, d, "events"), _quotas(spark), "event_type", ["ts", "event_id"]).select("event_id", "event_type")


@query("quota_shortage", "SELECT q.t AS event_type, q.quota, count(e.event_id) AS n FROM (VALUES ('click', 40), ('purchase', 25), ('signup', 1000000)) q(t, quota) LEFT JOIN events e ON e.event_type = q.t GROUP BY ALL HAVING count(e.event_id) < q.quota")
def quota_shortage(spark, d):
    return L.shortages(_read(spark, d, "events"), _quotas(spark), "event_type")


@query("ten_percent_sample", "SELECT doc_id FROM labels ORDER BY sha256(doc_id::VARCHAR), doc_id LIMIT (SELECT greatest(1, round_even(count(*) * 0.1, 0))::BIGINT FROM labels)")
def ten_percent_sample(spark, d):
    return L.tenth(_read(spark, d, "labels").select("doc_id"), "doc_id")


@query("resume_antijoin", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 50 = 0 AND user_id IS NOT NULL)")
def resume_antijoin(spark, d):
    e = _read(spark, d, "events").where("user_id is not null")
    return L.remaining(e, e.where("event_type = 'error' and event_id % 50 = 0"), ["user_id"]).select("event_id")


@query("provenance_filter", "SELECT event_id FROM events WHERE event_type IS NOT DISTINCT FROM 'view'")
def provenance_filter(spark, d):
    return _read(spark, d, "events").where(L.matches({"event_type": "view"})).select("event_id")


@query("normalize_contains", "SELECT conv_id, turn, n, length('the') > 0 AND contains(n, 'the') AS hit FROM (SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS n FROM conversations)")
def normalize_contains(spark, d):
    return _read(spark, d, "conversations").select("conv_id", "turn", T.normalised(F.col("text")).alias("n"), T.contains_answer(F.col("text"), F.lit("The")).alias("hit"))


@query("parse_final_answer", "SELECT conv_id, turn, split_part(trim(text), chr(10), 1) AS want FROM conversations WHERE trim(split_part(trim(text), chr(10), 1)) <> ''")
def parse_final_answer(spark, d):
    first = F.split_part(F.trim("text"), F.lit("\n"), F.lit(1))
    rows = _read(spark, d, "conversations").where(F.trim(F.split_part(F.trim("text"), F.lit("\n"), F.lit(1))) != "")
    return rows.select("conv_id", "turn", F.when(T.final_answer(F.concat(F.lit("note\nFinal_Answer : "), first, F.lit("\nrest"))) == F.trim(first), first).alias("want"))


@query("prompt_layout", f"""WITH c AS (SELECT conv_id, turn, text, 'CONTEXT[' || turn || ']:' || chr(10) AS head FROM conversations)
SELECT conv_id, sha256('{T.HEAD}' || string_agg(head || text || chr(10) || chr(10), '' ORDER BY turn) || 'QUERY:' || chr(10) || 'what?' || chr(10) || chr(10) || 'ASSISTANT:' || chr(10) || 'FINAL_ANSWER: ') AS prompt_hash, count(*) AS n FROM c GROUP BY conv_id""")
def prompt_layout(spark, d):
    c = _read(spark, d, "conversations").withColumn("q", F.lit("what?"))
    return T.prompts(c, "conv_id", "q", "turn", "turn", "text").select("conv_id", F.sha2("prompt", 256).alias("prompt_hash"), F.size("ranges").cast("long").alias("n"))


@query("hide_replace_tokens", """WITH x AS (SELECT vec_id, list_transform(range(10), lambda i: (vec_id * 7 + i * 3) % 101) AS ids, vec_id % 4 + 1 AS s, vec_id % 4 + 2 + vec_id % 3 AS e FROM embeddings)
SELECT vec_id, array_to_string(list_transform(range(10), lambda i: CASE WHEN i >= s AND i < e THEN -1 ELSE ids[i + 1] END), ',') AS hid, array_to_string(list_transform(range(10), lambda i: CASE WHEN i >= s AND i < e THEN 0 ELSE 1 END), ',') AS mask,
array_to_string(list_transform(range(10), lambda i: CASE WHEN i >= s AND i < e THEN 900 + vec_id % 10 + i - s ELSE ids[i + 1] END), ',') AS rep FROM x""")
def hide_replace_tokens(spark, d):
    e = _read(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: ((F.col("vec_id") * 7 + i * 3) % 101).cast("int")).alias("ids"), (F.col("vec_id") % 4 + 1).cast("int").alias("s"), (F.col("vec_id") % 4 + 2 + F.col("vec_id") % 3).cast("int").alias("e"))
    ones, allowed = F.array_repeat(F.lit(1), 10), F.sequence(F.lit(1), F.lit(8))
    hid = T.hidden(F.col("ids"), ones, F.col("s"), F.col("e"), F.lit(-1), allowed)
    donor = T.donor_prefix(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (900 + F.col("vec_id") % 10 + i).cast("int")), F.col("e") - F.col("s"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return e.select("vec_id", text(hid["ids"]).alias("hid"), text(hid["mask"]).alias("mask"), text(T.replaced(F.col("ids"), F.col("s"), F.col("e"), donor)).alias("rep"))


@query("hard_benign_faq", "SELECT item_id, substr(sha256('faq' || chr(1) || item_id || chr(1) || t), 1, 24) AS task_id FROM (SELECT b.item_id, 'FAQ' || chr(10) || 'Question: ' || b.text || chr(10) || 'Correct answer context: ' || d.text AS t FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 3 JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality > 0)")
def hard_benign_faq(spark, d):
    b = _read(spark, d, "benchmark").select("item_id", F.col("text").alias("q"), (F.col("item_id") * 3).alias("doc_id"))
    rows = b.join(_read(spark, d, "documents").select("doc_id", "text"), "doc_id").join(_read(spark, d, "labels").where("quality > 0").select("doc_id"), "doc_id")
    t = F.concat(F.lit("FAQ\nQuestion: "), "q", F.lit("\nCorrect answer context: "), "text")
    return rows.select("item_id", F.substring(F.sha2(F.concat_ws("\x01", F.lit("faq"), F.col("item_id").cast("string"), t), 256), 1, 24).alias("task_id"))


@query("boundary_judgments", "SELECT *, joint > clean AND joint_identifiable >= 0.5 AS persists, joint < modular AS weakened FROM (SELECT round(median(value) FILTER (event_type = 'view'), 6) AS clean, round(median(value) FILTER (event_type = 'click'), 6) AS modular, round(median(value) FILTER (event_type = 'purchase'), 6) AS joint, round(avg((event_id % 7 <> 0)::INTEGER) FILTER (event_type = 'purchase'), 6) AS joint_identifiable FROM events)")
def boundary_judgments(spark, d):
    e = _parts(spark, d).withColumn("kind", F.create_map(*map(F.lit, ("view", "clean", "click", "modular", "purchase", "joint")))[F.col("family")])
    return _round(E.boundary(e), "clean", "modular", "joint", "joint_identifiable")


@query("lock_diff", "SELECT coalesce(a.k, b.k) AS name, CASE WHEN a.k IS NULL THEN 'missing_local' WHEN b.k IS NULL THEN 'local_only' WHEN a.v <> b.v THEN 'changed' ELSE 'identical' END AS status FROM (SELECT p_partkey AS k, p_partkey % 5 AS v FROM part WHERE p_partkey % 3 > 0) a FULL JOIN (SELECT p_partkey AS k, p_partkey % 4 AS v FROM part WHERE p_partkey % 2 > 0) b ON a.k = b.k")
def lock_diff(spark, d):
    p = _read(spark, d, "part").select(F.col("p_partkey").alias("name"))
    return L.lock_diff(p.where("name % 3 > 0").withColumn("digest", F.col("name") % 5), p.where("name % 2 > 0").withColumn("digest", F.col("name") % 4))


@query("insertion_scan", "SELECT page_id, i - 1 AS line, substr(trim(l), 1, 300) AS text FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS l, generate_subscripts(string_split(html, chr(10)), 1) AS i FROM pages) WHERE regexp_matches(l, '(?i)contexts?\\s*\\.\\s*(append|insert)|track\\([0-9]+\\)')")
def insertion_scan(spark, d):
    rows = _read(spark, d, "pages").select("page_id", F.posexplode(F.split("html", "\n")).alias("line", "l"))
    return rows.where(F.rlike("l", F.lit(r"(?i)contexts?\s*\.\s*(append|insert)|track\([0-9]+\)"))).select("page_id", F.col("line").cast("long").alias("line"), F.substring(F.trim("l"), 1, 300).alias("text"))


@query("label_free_projection", "SELECT d.doc_id, lang, n_chars FROM documents d JOIN labels USING (doc_id)")
def label_free_projection(spark, d):
    j = _read(spark, d, "documents").join(_read(spark, d, "labels"), "doc_id")
    return L.label_free(j, ["doc_id", "lang", "n_chars"], {"quality", "toxic"})


@query("index_lookup", "SELECT l.doc_id % 7 AS query_id, l.doc_id, row_number() OVER (PARTITION BY l.doc_id % 7 ORDER BY l.doc_id) - 1 AS position, d.lang, d.n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def index_lookup(spark, d):
    place = (F.row_number().over(W.partitionBy("query_id").orderBy("doc_id")) - 1).cast("long")
    results = _read(spark, d, "labels").select((F.col("doc_id") % 7).alias("query_id"), "doc_id").withColumn("position", place)
    return R.looked_up(results, _read(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


@query("first_relevant_chunk", "SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem WHERE l_orderkey % 3 > 0 AND (l_orderkey + l_partkey) % 5 - 2 > 0) WHERE n = 1")
def first_relevant_chunk(spark, d):
    pool = _read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    qrels = pool.where("l_orderkey % 3 > 0").select("l_orderkey", "l_partkey", ((F.col("l_orderkey") + F.col("l_partkey")) % 5 - 2).alias("score")).distinct()
    return R.first_relevant(pool, qrels, "l_orderkey", "l_partkey", "l_linenumber")


@query("final_log_join", "SELECT c.c_custkey AS task_id, epoch, loss, CASE WHEN epoch IS NULL THEN 'missing' ELSE 'found' END AS status FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS epoch, arg_max(o_totalprice, o_orderkey) AS loss FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey")
def final_log_join(spark, d):
    log = _read(spark, d, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("epoch"), F.col("o_totalprice").alias("loss"))
    return L.with_last(_read(spark, d, "customer").select(F.col("c_custkey").alias("task_id")), log, ["task_id"], "epoch", "loss")


@query("shard_merge", "SELECT c_nationkey AS shard, c_custkey AS chunk_id, row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS row_id FROM customer")
def shard_merge(spark, d):
    rows = _read(spark, d, "customer").select(F.col("c_nationkey").alias("shard"), F.col("c_custkey").alias("chunk_id"))
    return L.merged_shards(rows, "shard", "chunk_id", "chunk_id")


@query("scored_id_mismatch", "SELECT coalesce(a.k, b.k) AS doc_id, CASE WHEN b.k IS NULL THEN 'scored' ELSE 'candidate' END AS side FROM (SELECT DISTINCT doc_id AS k FROM labels) a FULL JOIN (SELECT DISTINCT doc_id AS k FROM documents WHERE n_chars > 200) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def scored_id_mismatch(spark, d):
    return L.unmatched(_read(spark, d, "labels"), _read(spark, d, "documents").where("n_chars > 200"), "doc_id")


@query("record_hashes", """SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}') AS hash FROM events WHERE event_type IS NOT NULL""")
def record_hashes(spark, d):
    return _read(spark, d, "events").where("event_type is not null").select("event_id", L.record_hash("event_id", "event_type").alias("hash"))


@query("determinism_compare", "SELECT coalesce(a.k, b.k) AS query_id, coalesce(a.s IS NOT DISTINCT FROM b.s AND a.p IS NOT DISTINCT FROM b.p AND a.k IS NOT NULL AND b.k IS NOT NULL, false) AS exact FROM (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 'x' ELSE o_orderstatus END AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 13 > 0) b ON a.k = b.k")
def determinism_compare(spark, d):
    run = _read(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderstatus").alias("answer"), F.col("o_totalprice").alias("score"))
    again = run.where("query_id % 13 > 0").withColumn("answer", F.when(F.col("query_id") % 10 == 0, "x").otherwise(F.col("answer")))
    return E.compared_runs(run, again, "query_id", ["answer", "score"])


@query("span_iou", "SELECT doc_id, round(CASE WHEN doc_id % 4 = 0 AND n = 0 THEN 1 ELSE i / (n + o - i)::DOUBLE END, 9) AS iou FROM (SELECT doc_id, n_chars % 40 AS n, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 20 END AS o, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE greatest(0, least(n_chars % 40, 30) - 10) END AS i FROM documents)")
def span_iou(spark, d):
    r = lambda a, b: F.array(F.struct(a.cast("long").alias("start"), b.cast("long").alias("end")))
    oracle = F.when(F.col("doc_id") % 4 == 0, r(F.lit(0), F.lit(0))).otherwise(F.concat(r(F.lit(10), F.lit(25)), r(F.lit(20), F.lit(30))))
    return _round(_read(spark, d, "documents").select("doc_id", A.span_iou(r(F.lit(0), F.col("n_chars") % 40), oracle).alias("iou")), "iou", n=9)


@query("direction_stability", "SELECT role, count(*) AS n, count_if(m = t AND m <> 0)::BIGINT AS k, round(count_if(m = t AND m <> 0) / count(*)::DOUBLE, 9) AS rate FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'anchor' ELSE 'payload' END AS role, quality * 2 - 1 AS m, 1 - toxic * 2 AS t FROM labels) GROUP BY role")
def direction_stability(spark, d):
    rows = _read(spark, d, "labels").select(F.when(F.col("doc_id") % 2 == 0, "anchor").otherwise("payload").alias("role"), (F.col("quality") * 2 - 1).alias("mask_direction"), (1 - F.col("toxic") * 2).alias("donor_direction"))
    return _round(E.direction_stability(rows).select("role", "n", "k", "rate"), "rate", n=9)


@query("donor_replacements", """SELECT doc_id, 0 AS "start", 10 AS "end", round(avg(((doc_id * 7 + donor) % 5) / 4e0), 9) AS r_eff, round(avg(((doc_id + donor * 3) % 7) / 8e0), 9) AS g_eff FROM labels, (SELECT unnest(range(8)) AS donor) GROUP BY doc_id""")
def donor_replacements(spark, d):
    rows = _read(spark, d, "labels").select("doc_id", F.lit(0).alias("start"), F.lit(10).alias("end"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("donor"))
    scores = rows.withColumn("r_eff", (F.col("doc_id") * 7 + F.col("donor")) % 5 / 4).withColumn("g_eff", (F.col("doc_id") + F.col("donor") * 3) % 7 / 8)
    return _round(A.donor_effects(scores, "doc_id"), "r_eff", "g_eff", n=9)


@query("cluster_bootstrap_hash", """WITH held AS (SELECT event_type AS c, value AS v FROM events WHERE value IS NOT NULL), names AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT c FROM held)),
picks AS (SELECT k, ('0x' || substr(md5(k || ':' || i), 1, 7))::BIGINT % n AS i FROM names, (SELECT unnest(range(1, 10001)) AS k)), medians AS (SELECT k, median(v) AS m FROM picks JOIN names USING (i) JOIN held USING (c) GROUP BY k)
SELECT round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM medians""")
def cluster_bootstrap_hash(spark, d):
    return _round(S.cluster_bootstrap_hash(_read(spark, d, "events"), "event_type", "value"), "ci_low", "ci_high")


@query("audit_decision", "WITH c AS (SELECT event_type AS name, CASE WHEN count_if(value IS NULL) > 0 THEN 'FAIL' WHEN count(*) >= 20 THEN 'PASS_FUNCTIONAL' ELSE 'WARN' END AS status FROM events WHERE event_type IS NOT NULL GROUP BY event_type), a(name, place, required) AS (VALUES ('click', 0, true), ('view', 1, true), ('error', 2, false)) SELECT CASE WHEN bool_and(NOT required OR status = 'PASS_FUNCTIONAL') THEN 'PASS' ELSE 'FAIL' END AS decision, string_agg(name || ': ' || status || CASE WHEN required THEN '' ELSE ', informational' END, '; ' ORDER BY place) AS reasons FROM a JOIN c USING (name)")
def audit_decision(spark, d):
    parts = _read(spark, d, "events").where("event_type is not null").groupBy(F.col("event_type").alias("name")).agg(E.audit_status(F.count("*"), F.count_if(F.col("value").isNull())).alias("status"))
    return E.audit_decision(parts, ["click", "view"], ["error"]).select("decision", F.array_join("reasons", "; ").alias("reasons"))


@query("ledger_samples", "SELECT l.l_orderkey, l.l_linenumber, l.l_partkey AS sample_id, p_name, p_size FROM lineitem l JOIN part ON p_partkey = l.l_partkey")
def ledger_samples(spark, d):
    p = _read(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), "p_name", "p_size").withColumn("ord", F.lit(1))
    rows = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("sample_id"))
    return L.with_samples(rows, p.unionByName(p.withColumn("p_name", F.lit("before")).withColumn("ord", F.lit(0))), ["ord"]).drop("ord")


@query("canonical_hashes", """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"inner":{"a":[' || n_chars || ',null],"lang":"' || lang || '"},"text":"' || replace(replace(replace(replace(text, chr(92), repeat(chr(92), 2)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't') || '"}') AS hash FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL""")
def canonical_hashes(spark, d):
    rows = _read(spark, d, "documents").where("text is not null and lang is not null").select("doc_id", "text", F.struct("lang", F.array(F.col("n_chars"), F.lit(None)).alias("a")).alias("inner"))
    return PR.row_hash(rows, ["text", "inner", "doc_id"]).select("doc_id", "hash")


@query("mechanism_gate", "SELECT bool_and(p < 0.05 AND low > 0) AS passed FROM (SELECT event_type, 1 / (count(*) + 1e0) AS p, min(value) AS low FROM events WHERE value IS NOT NULL GROUP BY event_type)")
def mechanism_gate(spark, d):
    tests = _read(spark, d, "events").where("value is not null").groupBy("event_type").agg((1 / (F.count("*") + 1)).alias("p_adj"), F.min("value").alias("ci_low"))
    return E.mechanism_gate(tests)


@query("final_verdict", "WITH g AS (SELECT bool_and(n_chars >= 0) AS audit, bool_and(doc_id IS NOT NULL) AS determinism, bool_and(n_chars < 1000000) AS mechanism, bool_and(lang IS NOT NULL) AS robustness, bool_or(n_chars > 5000) AS weakened FROM documents) SELECT CASE WHEN NOT audit OR NOT determinism OR NOT mechanism THEN 'terminate' WHEN NOT robustness OR weakened THEN 'narrow' ELSE 'open' END AS verdict, CASE WHEN NOT audit THEN 'audit' WHEN NOT determinism THEN 'determinism' WHEN NOT mechanism THEN 'mechanism' WHEN NOT robustness THEN 'robustness' WHEN weakened THEN 'weakened' END AS reason FROM g")
def final_verdict(spark, d):
    b = _read(spark, d, "documents").agg(F.bool_and(F.col("n_chars") >= 0).alias("audit"), F.bool_and(F.col("doc_id").isNotNull()).alias("determinism"), F.bool_and(F.col("n_chars") < 1000000).alias("mechanism"), F.bool_and(F.col("lang").isNotNull()).alias("robustness"), F.bool_or(F.col("n_chars") > 5000).alias("weakened"))
    return E.final_verdict(b.unpivot([], b.columns, "gate", "passed"))


@query("answer_logprob", "WITH r AS (SELECT vec_id, t, embedding[t * 8 - 7 : t * 8]::DOUBLE[] AS e FROM embeddings, (SELECT unnest(range(1, 8)) AS t)) SELECT vec_id, round(avg(e[(vec_id + t) % 8 + 1] - ln(list_sum(list_transform(e, lambda x: exp(x))))), 5) AS mean_logp FROM r GROUP BY vec_id")
def answer_logprob(spark, d):
    """The 64 values of a vector as logits of 8 places over 8 words."""
    e = F.col("embedding").cast("array<double>")
    places = F.sequence(F.lit(0), F.lit(7))
    logits = F.transform(places, lambda t: F.slice(e, t * 8 + 1, F.lit(8)))
    labels = F.transform(places, lambda t: ((F.col("vec_id") + t) % 8).cast("int"))
    return _round(_read(spark, d, "embeddings").select("vec_id", T.mean_answer_logprob(logits, labels, F.array_repeat(F.lit(True), 8)).alias("mean_logp")), "mean_logp", n=5)


@query("chunk_ranges", f"""WITH {_CHUNK} SELECT doc_id, chunk_no, greatest(char_start, 10) AS anchor_start, least(char_end, 400) AS anchor_end, greatest(char_start, 10) - char_start AS anchor_chunk_start, least(char_end, 400) - char_start AS anchor_chunk_end FROM chunks WHERE least(char_end, 400) > greatest(char_start, 10)""")
def chunk_ranges(spark, d):
    docs = _read(spark, d, "documents").withColumn("anchor", F.array(F.struct(F.lit(10).alias("start"), F.lit(400).alias("end")), F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))))
    c = K.chunks(docs, SIZE, OVERLAP, ranges=["anchor"]).where(F.size("anchor_source") > 0)
    one = lambda c, f: F.get(c, 0)[f]
    return c.select("doc_id", "chunk_no", one("anchor_source", "start").alias("anchor_start"), one("anchor_source", "end").alias("anchor_end"), one("anchor_chunk", "start").alias("anchor_chunk_start"), one("anchor_chunk", "end").alias("anchor_chunk_end"))


@query("token_map", f"WITH {_TOK} SELECT doc_id, count(*) AS n, min(token_index) AS first_token, max(token_index) AS last_token, min(greatest(char_start, 50) - 50) AS first_start, max(least(char_end, 120) - 50) AS last_end FROM tokens WHERE char_start < 120 AND char_end > 50 GROUP BY doc_id")
def token_map(spark, d):
    mapped = K.prompt_token_map(F.col("tokens"), F.lit(50), F.lit(120))
    m = K.with_tokens(_read(spark, d, "documents").select("doc_id", "text"), ids=False).select("doc_id", mapped.alias("m"), "tokens").where(F.size("m") > 0)
    ends = lambda c: (F.array_min(F.transform("m", lambda x: x[c])), F.array_max(F.transform("m", lambda x: x[c])))
    return m.select("doc_id", K.overlap_count(F.col("tokens"), F.lit(50), F.lit(120)).cast("long").alias("n"), F.array_min(K.overlapping(F.col("tokens"), F.lit(50), F.lit(120))).alias("first_token"), ends("index")[1].alias("last_token"), ends("start")[0].alias("first_start"), ends("end")[1].alias("last_end"))


@query("token_ids")
def token_ids(spark, d):
    """Every token with its id; SQL has no BLAKE2b."""
    return K.token_offsets(_read(spark, d, "documents"), ids=True).select("doc_id", "token_index", "token_id")


_POOLED = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
c AS (SELECT NULL AS own, vec_id AS chunk_id, embedding::DOUBLE[] AS v, false AS injected FROM embeddings UNION ALL SELECT q.query_id, -1 - e.vec_id, e.embedding::DOUBLE[], true FROM q JOIN embeddings e ON e.vec_id IN (q.query_id + 1, q.query_id + 2)),
s AS (SELECT query_id, chunk_id, injected, list_dot_product(q.v, c.v) AS x FROM q, c WHERE own IS NULL OR own = query_id),
pool AS (SELECT query_id, chunk_id, injected, x AS dense_score, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9) DESC, chunk_id) AS dense_rank, x * ((abs(chunk_id) * 37) % 11 - 3) / 7e0 AS rerank_score FROM s QUALIFY dense_rank <= 20),
m AS (SELECT query_id, median(dense_score) AS dm, median(rerank_score) AS rm, list_sort(list(dense_score), 'DESC')[20] AS dense_thr, list_sort(list(rerank_score), 'DESC')[5] AS rerank_thr FROM pool GROUP BY query_id),
thr AS (SELECT query_id, first(dense_thr) AS dense_thr, first(rerank_thr) AS rerank_thr, greatest(1e-8, median(abs(dense_score - dm))) AS dense_mad, greatest(1e-8, median(abs(rerank_score - rm))) AS rerank_mad FROM pool JOIN m USING (query_id) GROUP BY query_id),
sel AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, chunk_id) AS rerank_rank FROM pool JOIN thr USING (query_id) QUALIFY rerank_rank <= 5)"""


def _rerank(rows: DataFrame) -> DataFrame:
    """A stand-in for a reranking model."""
    return rows.select("query_id", "chunk_id", (F.col("dense_score") * ((F.abs("chunk_id") * 37) % 11 - 3) / F.lit(7.0)).alias("rerank_score"))


def _retrieval_inputs(spark, d):
    e = _read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    queries = e.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vec").withColumn("query", F.concat(F.lit("what about "), F.col("query_id").cast("string"), F.lit("?")))
    more = queries.select("query_id").join(e.select((F.col("chunk_id") * -1 - 1).alias("id"), F.col("chunk_id").alias("of"), "vec"), (F.col("of") - F.col("of") % 50 == F.col("query_id")) & (F.col("of") % 50).isin(1, 2))
    return e, queries, more.select("query_id", F.col("id").alias("chunk_id"), "vec")


def _texts(spark, d):
    """The whole document of a vector's number, for the vector and for its injected copy."""
    c = _read(spark, d, "documents").where("text is not null")
    both = F.explode(F.array(F.col("doc_id"), -1 - F.col("doc_id")))
    return c.select(both.alias("chunk_id"), "text", F.col("doc_id").alias("source_doc_id"), (F.col("doc_id") % 2 == 0).alias("injected"))


def _selected(spark, d):
    vectors, queries, more = _retrieval_inputs(spark, d)
    return C.retrieve(vectors, queries, _rerank, 20, 5, more), queries


@query("retrieve_with_injected", f"WITH {_POOLED} SELECT query_id, chunk_id, injected, CAST(dense_rank AS INTEGER) AS dense_rank, CAST(rerank_rank AS INTEGER) AS rerank_rank, CAST(rerank_rank - 1 AS INTEGER) AS position, round(dense_thr, 6) AS dense_thr, round(rerank_thr, 6) AS rerank_thr, round(dense_mad, 6) AS dense_mad, round(rerank_mad, 6) AS rerank_mad FROM sel")
def retrieve_with_injected(spark, d):
    s = _selected(spark, d)[0].select("query_id", "chunk_id", "injected", "dense_rank", "rerank_rank", "position", "dense_thr", "rerank_thr", "dense_mad", "rerank_mad")
    return _round(s, "dense_thr", "rerank_thr", "dense_mad", "rerank_mad")


_TEXTS = """texts AS (SELECT unnest([doc_id, -1 - doc_id]) AS chunk_id, doc_id, text FROM documents WHERE text IS NOT NULL)"""


@query("detector_events", f"""WITH {_POOLED}, {_TEXTS}, x AS (SELECT sel.*, text FROM sel JOIN texts USING (chunk_id))
SELECT query_id, string_agg(chunk_id, ',' ORDER BY rerank_rank) AS context, string_agg(dense_rank || ':' || rerank_rank, ',' ORDER BY rerank_rank) AS trace,
sha256('{T.HEAD}' || string_agg('CONTEXT[' || (rerank_rank - 1) || ']:' || chr(10) || text || chr(10) || chr(10), '' ORDER BY rerank_rank) || 'QUERY:' || chr(10) || 'what about ' || query_id || '?' || chr(10) || chr(10) || 'ASSISTANT:' || chr(10) || 'FINAL_ANSWER: ') AS prompt_hash, sum(length(text))::BIGINT AS n_chars FROM x GROUP BY query_id""")
def detector_events(spark, d):
    selected, queries = _selected(spark, d)
    event = C.events(selected, _texts(spark, d), queries, 20, 5)
    # the ranges must hold the chunks' own texts
    own = F.array_join(F.transform("ranges", lambda r: F.substring(F.col("prompt"), r["start"] + 1, r["end"] - r["start"])), "")
    same = own == F.array_join(F.transform("chunks", lambda c: c["text"]), "")
    return event.select("query_id", F.array_join(F.col("context_order").cast("array<string>"), ",").alias("context"), F.array_join(F.transform("retrieval_trace", lambda t: F.concat_ws(":", t["dense_rank"].cast("string"), t["rerank_rank"].cast("string"))), ",").alias("trace"), F.sha2("prompt", 256).alias("prompt_hash"), F.when(same, F.length(own)).cast("long").alias("n_chars"))


_EFFECTS = f"""{_POOLED}, {_TOK}, {_TEXTS},
chosen AS (SELECT DISTINCT chunk_id, doc_id, length(text) AS n FROM sel JOIN texts USING (chunk_id)),
sv AS (SELECT chunk_id, v, v + 32 * ((token_index - v) // 32) AS s, min(t.char_start) AS st, max(t.char_end) AS en, first(n) AS n FROM chosen x, (SELECT unnest([0, 16]) AS v), tokens t WHERE t.doc_id = x.doc_id AND token_index >= v GROUP BY chunk_id, v, (token_index - v) // 32),
eff AS (SELECT query_id, chunk_id, v, s, st, en, least((dense_score - dense_thr) / dense_mad, (rerank_score - rerank_thr) / rerank_mad) - least((dense_score * (1 - (en - st) / n::DOUBLE / 2) - dense_thr) / dense_mad, (rerank_score - (s + v + 1) % 7 / 10e0 - abs(chunk_id) % 97 / 10000e0 - rerank_thr) / rerank_mad) AS r_eff,
  -0.5e0 + 1 + (st * 7 + abs(chunk_id) + query_id) % 11 / 10e0 - 0.7e0 AS g_eff FROM sel JOIN sv USING (chunk_id)),
top AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(greatest(r_eff, 0)), 6) DESC, chunk_id) AS k FROM eff GROUP BY query_id, chunk_id)"""
_ROLES = """pts AS (SELECT DISTINCT query_id, chunk_id, unnest([st, en]) AS p FROM spans),
gaps AS (SELECT query_id, chunk_id, p AS a, lead(p) OVER (PARTITION BY query_id, chunk_id ORDER BY p) AS b FROM pts),
atoms AS (SELECT g.query_id, g.chunk_id, a, b, avg(r_eff) AS r_eff, avg(g_eff) AS g_eff FROM gaps g JOIN spans s ON g.query_id = s.query_id AND g.chunk_id = s.chunk_id AND s.st < b AND s.en > a GROUP BY ALL),
mass AS (SELECT *, sum(greatest(r_eff, 0)) OVER w AS r_mass, sum(greatest(g_eff, 0)) OVER w AS g_mass FROM atoms WINDOW w AS (PARTITION BY query_id, chunk_id)),
roles AS (SELECT query_id, chunk_id, first(r_mass) AS r_mass, first(g_mass) AS g_mass, CASE WHEN first(r_mass) > 1e-8 AND first(g_mass) > 1e-8 THEN least(1, 0.5e0 * sum(abs(greatest(r_eff, 0) / r_mass - greatest(g_eff, 0) / g_mass))) ELSE 0 END AS t_rg FROM mass GROUP BY query_id, chunk_id)"""


def _hidden(spans: DataFrame) -> DataFrame:
    """A stand-in for scores of a chunk without a span."""
    dense = F.col("dense_score") * (1 - (F.col("end") - F.col("start")) / F.col("n_chars") / 2)
    return spans.select(*C.SPAN, dense.alias("dense"), (F.col("rerank_score") - (F.col("tok_start") + F.col("view") + 1) % 7 / F.lit(10.0) - F.abs("chunk_id") % 97 / F.lit(10000.0)).alias("rerank"))


def _teacher(spans: DataFrame) -> DataFrame:
    return spans.select(*C.SPAN, (F.lit(-0.3) - ((F.col("start") * 7 + F.abs("chunk_id") + F.col("query_id")) % 11) / F.lit(10.0)).alias("logp"))


def _full(rows: DataFrame) -> DataFrame:
    return rows.select("query_id").distinct().withColumn("full_logp", F.lit(-0.5))


@query("score_queries", f"WITH {_EFFECTS}, spans AS (SELECT eff.* FROM eff JOIN top USING (query_id, chunk_id) WHERE k <= 2), {_ROLES}, all_q AS (SELECT DISTINCT query_id FROM pool) SELECT query_id, round(coalesce(max(t_rg), 0), 6) AS query_score, coalesce(string_agg(chunk_id, ',' ORDER BY chunk_id), '') AS selected FROM all_q LEFT JOIN roles USING (query_id) GROUP BY query_id")
def score_queries(spark, d):
    """From queries to scores in one call: retrieval, events, span effects, the two best chunks, role maps."""
    vectors, queries, more = _retrieval_inputs(spark, d)
    found = C.score_queries(vectors, queries, _texts(spark, d), _rerank, _hidden, _teacher, _full, 20, 5, more)[0]
    return C.pilot(found).select("query_id", F.round("query_score", 6).alias("query_score"), F.array_join(F.col("selected_for_generation").cast("array<string>"), ",").alias("selected"))


def _effects(spark, d):
    selected, queries = _selected(spark, d)
    return C.retrieval_effects(C.chunk_spans(selected, _texts(spark, d).select("chunk_id", "text")), _hidden), queries


@query("score_chunks", f"WITH {_EFFECTS}, asked AS (SELECT query_id, min(chunk_id) AS chunk_id FROM eff GROUP BY query_id), spans AS (SELECT eff.* FROM eff JOIN asked USING (query_id, chunk_id)), {_ROLES} SELECT query_id, chunk_id, round(r_mass, 6) AS r_mass, round(g_mass, 6) AS g_mass, round(t_rg, 6) AS t_rg FROM roles")
def score_chunks(spark, d):
    spans, queries = _effects(spark, d)
    asked = spans.groupBy("query_id").agg(F.min("chunk_id").alias("chunk_id"))
    mapped = C.score_chunks(spans, _full(queries), _teacher, asked)
    return _round(A.chunk_roles(mapped, *C.CHUNK).select("query_id", "chunk_id", "r_mass", "g_mass", "t_rg"), "r_mass", "g_mass", "t_rg")


@query("score_donors", f"""WITH {_EFFECTS}, spans AS (SELECT query_id, chunk_id, s, st, en, avg(least((dense_score - dense_thr) / dense_mad, (rerank_score - rerank_thr) / rerank_mad) - least((dense_score * (1 - (donor + 1) / 50e0) - dense_thr) / dense_mad, (rerank_score - donor / 20e0 - s % 3 / 10e0 - rerank_thr) / rerank_mad)) AS r_eff,
avg(-0.5e0 + 1 + (st + donor * 3 + abs(chunk_id)) % 7 / 10e0) AS g_eff FROM eff JOIN sel USING (query_id, chunk_id), (SELECT unnest(range(8)) AS donor) GROUP BY query_id, chunk_id, v, s, st, en), {_ROLES} SELECT query_id, chunk_id, round(r_mass, 6) AS r_mass, round(g_mass, 6) AS g_mass, round(t_rg, 6) AS t_rg FROM roles""")
def score_donors(spark, d):
    spans, queries = _effects(spark, d)
    donors = queries.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("donor_id")).withColumn("donor", F.lit("x"))

    def replaced(rows):
        dense, rerank = F.col("dense_score") * (1 - (F.col("donor_id") + 1) / F.lit(50.0)), F.col("rerank_score") - F.col("donor_id") / F.lit(20.0) - F.col("tok_start") % 3 / F.lit(10.0)
        return rows.select(*C.SPAN, "donor_id", dense.alias("dense"), rerank.alias("rerank"), (-1 - ((F.col("start") + F.col("donor_id") * 3 + F.abs("chunk_id")) % 7) / F.lit(10.0)).alias("logp"))

    mapped = C.score_donors(spans.drop("r_eff"), donors, _full(queries), replaced)
    return _round(A.chunk_roles(mapped, *C.CHUNK).select("query_id", "chunk_id", "r_mass", "g_mass", "t_rg"), "r_mass", "g_mass", "t_rg")


@query("no_op_deltas", f"WITH {_POOLED} SELECT query_id, chunk_id, round(abs(least((dense_score - dense_thr) / dense_mad, (rerank_score - rerank_thr) / rerank_mad) - least((dense_score + 1e-3 - dense_thr) / dense_mad, (rerank_score - rerank_thr) / rerank_mad)), 6) AS retrieval_delta, (chunk_id % 3 = 0)::INTEGER / 8e0 AS generation_delta FROM sel")
def no_op_deltas(spark, d):
    first = _selected(spark, d)[0].withColumn("logp", F.lit(-1.0))
    again = first.withColumn("dense_score", F.col("dense_score") + 1e-3).withColumn("logp", F.when(F.col("chunk_id") % 3 == 0, -1.125).otherwise(-1.0))
    return _round(C.no_op_deltas(first, again), "retrieval_delta")


@query("oracle_values", f"""WITH {_ROLE}, o AS (SELECT *, min("start") OVER (PARTITION BY doc_id, chunk_no) AS o FROM share)
SELECT doc_id, chunk_no, round(sum(p_r * greatest(0, least("end", o + 60) - greatest("start", o)) / ("end" - "start")), 6) AS anchor_p_retrieval, round(sum(p_g * greatest(0, least("end", o + 60) - greatest("start", o)) / ("end" - "start")), 6) AS anchor_p_generation,
round(sum(p_r * greatest(0, least("end", o + 200) - greatest("start", o + 60)) / ("end" - "start")), 6) AS payload_p_retrieval, round(sum(p_g * greatest(0, least("end", o + 200) - greatest("start", o + 60)) / ("end" - "start")), 6) AS payload_p_generation FROM o GROUP BY doc_id, chunk_no""")
def oracle_values(spark, d):
    m = _mapped(spark, d)
    o = m.groupBy("doc_id", "chunk_no").agg(F.min("start").alias("o"))
    ranges = [o.select("doc_id", "chunk_no", (F.col("o") + a).alias("start"), (F.col("o") + b).alias("end")) for a, b in ((0, 60), (60, 200))]
    return _round(C.oracle_values(m, *ranges, "doc_id", "chunk_no"), "anchor_p_retrieval", "anchor_p_generation", "payload_p_retrieval", "payload_p_generation")


@query("first_donors", f"WITH {_VEC}, once AS (SELECT query_id, chunk_id, dense_score AS score FROM pool WHERE chunk_id % 5 <> query_id % 5 AND chunk_id % 7 > 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS donor_rank FROM once) SELECT query_id, chunk_id, CAST(donor_rank AS INTEGER) AS donor_rank FROM r WHERE donor_rank <= 4")
def first_donors(spark, d):
    c = _pool(spark, d).select("query_id", "chunk_id", F.col("dense_score").alias("score"), (F.col("chunk_id") % 5).alias("source"), (F.col("query_id") % 5).alias("own_source"), (F.col("chunk_id") % 7 > 0).alias("fits"))
    return R.first_donors(c.union(c.limit(5)), 4).select("query_id", "chunk_id", "donor_rank")


@query("sliced_ids", "SELECT doc_id FROM documents ORDER BY CAST(doc_id AS VARCHAR) LIMIT 50 OFFSET 20")
def sliced_ids(spark, d):
    return C.sliced(_read(spark, d, "documents").select("doc_id"), "doc_id", 20, 50)


@query("shard_of_tasks", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS i FROM documents) WHERE i % 8 = 3")
def shard_of_tasks(spark, d):
    ids = _read(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"))
    return C.in_shard(ids, "name", 3, 8).select("doc_id")


@query("sign_flip_median_hash", f"WITH {_SIGNS}, s AS (SELECT k, round(median(v), 9) AS s FROM d GROUP BY k), o AS (SELECT round(median(value), 9) AS observed FROM events) SELECT observed, (count_if(s >= observed) + 1) / 10001e0 AS p FROM s, o GROUP BY observed")
def sign_flip_median_hash(spark, d):
    return S.sign_flip_hash(_read(spark, d, "events").where("value is not null"), "event_id", "value", statistic="median")


@query("mechanism_tests")
def mechanism_tests(spark, d):
    """Three paired hypotheses over users, with 10,000 permutations and replicates each."""
    e = _read(spark, d, "events").where("value is not null and user_id is not null").groupBy((F.col("user_id") % 40).alias("query_id"), "user_id")
    mean = lambda kind: F.coalesce(F.avg(F.when(F.col("event_type") == kind, F.col("value"))), F.lit(0.0))
    o = e.agg(mean("view").alias("anchor_p_retrieval"), mean("error").alias("anchor_p_generation"), mean("click").alias("payload_p_retrieval"), mean("purchase").alias("payload_p_generation"), mean("signup").alias("poison_t_rg"), F.lit(0.0).alias("clean_t_rg"))
    return E.mechanism_tests(o)


_HB = """qs AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text FROM benchmark), rel AS (SELECT CAST(item_id AS VARCHAR) AS query_id, CAST(item_id * 3 + j AS VARCHAR) AS doc, item_id * 10 + j AS ord, (item_id + j) % 3 AS score FROM benchmark, (SELECT unnest(range(4)) AS j)),
ds AS (SELECT CAST(doc_id AS VARCHAR) AS doc, doc_id AS line_no, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS title, text FROM documents),
ids AS (SELECT query_id, text, row_number() OVER (ORDER BY query_id) - 1 AS i FROM qs),
hits AS (SELECT ids.query_id, ids.text AS query, i, ord, doc, title, ds.text, row_number() OVER (PARTITION BY ids.query_id ORDER BY ord, doc) AS r, count(*) OVER (PARTITION BY ids.query_id) AS c FROM ids JOIN rel USING (query_id) JOIN ds USING (doc) WHERE score > 0),
one AS (SELECT *, row_number() OVER (ORDER BY query_id) AS k FROM hits WHERE r = 1 AND i < 200), titled AS (SELECT *, row_number() OVER (ORDER BY line_no) AS k FROM ds WHERE title <> ''),
two AS (SELECT query_id, query, string_agg('Bridge evidence ' || r || ' (' || title || '): ' || text, chr(10) || chr(10) ORDER BY r) AS t FROM hits WHERE r <= 2 AND c >= 2 AND i < 500 GROUP BY query_id, query),
tasks AS (SELECT 'faq' AS "group", query_id, 'FAQ' || chr(10) || 'Question: ' || query || chr(10) || 'Correct answer context: ' || text AS t FROM one WHERE k <= 100
UNION ALL SELECT 'entity_locator_answer_fact', query_id, 'Entity locator: ' || title || chr(10) || 'Answer fact: ' || text FROM one WHERE k <= 100
UNION ALL SELECT 'title_body', 'title-body-' || doc, 'Title: ' || title || chr(10) || 'Body: ' || text FROM titled WHERE k <= 100
UNION ALL SELECT 'hotpot_bridge', query_id, t FROM (SELECT *, row_number() OVER (ORDER BY query_id) AS k FROM two) WHERE k <= 100)"""


@query("hard_benign_tasks", f"""WITH {_HB} SELECT "group", query_id, sha256(t) AS text_hash FROM tasks""")
def hard_benign_tasks(spark, d):
    b = _read(spark, d, "benchmark")
    queries = b.select(F.col("item_id").cast("string").alias("query_id"), "text")
    qrels = b.select("item_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j")).select(F.col("item_id").cast("string").alias("query_id"), (F.col("item_id") * 3 + F.col("j")).cast("string").alias("source_doc_id"), (F.col("item_id") * 10 + F.col("j")).alias("ord"), ((F.col("item_id") + F.col("j")) % 3).alias("score"))
    docs = _read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("record_id"), F.col("doc_id").alias("line_no"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("lang")).alias("title"), "text")
    return X.hard_benign(queries, qrels, docs, queries, qrels, docs, strict=False).select("group", "query_id", F.sha2("text", 256).alias("text_hash"))


@query("smoke", "WITH x AS (SELECT conv_id * 100 + turn AS ord, text, (conv_id + turn) % 3 > 0 AS hit, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS n, trim(regexp_replace(lower(substr(text, 5, 9)), '[^a-z0-9]+', ' ', 'g')) AS want FROM conversations), f AS (SELECT * FROM x ORDER BY ord LIMIT 20) SELECT count(*) AS n, count_if(hit) / count(*)::DOUBLE AS hit_rate, count_if(hit AND want <> '' AND contains(n, want)) / nullif(count_if(hit), 0)::DOUBLE AS conditional, count_if(hit AND want <> '' AND contains(n, want)) / count(*)::DOUBLE AS end_to_end, count_if(hit)::BIGINT AS lineage FROM f")
def smoke(spark, d):
    c = _read(spark, d, "conversations")
    return X.smoke(c.select((F.col("conv_id") * 100 + F.col("turn")).alias("ord"), F.lit("q").alias("question"), F.substring("text", 5, 9).alias("incorrect_answer"), F.col("text").alias("output"), F.when((F.col("conv_id") + F.col("turn")) % 3 > 0, F.array(F.lit("q and more"))).otherwise(F.array().cast("array<string>")).alias("injected_adv")))


@query("hard_benign_rates")
def hard_benign_rates(spark, d):
    """False flags of four groups, with exact intervals, against a frozen calibration set."""
    e = _read(spark, d, "events").where("value is not null")
    groups = F.element_at(F.array(*map(F.lit, X.GROUPS)), (F.col("event_id") % 4 + 1).cast("int"))
    rows = e.where("event_id % 3 > 0").select(groups.alias("group"), F.col("event_id").alias("task_id"), F.col("event_id").alias("ord"), F.col("value").alias("score"), (F.col("event_id") % 5 > 0).alias("injected_survives"))
    return X.hard_benign_summary(rows, e.where("event_id % 3 = 0").select(F.col("event_id").alias("ord"), F.col("value").alias("score")), 100, 200)
