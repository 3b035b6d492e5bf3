"""Readers with explicit schemas: corpora, queries, judgments, nested results, ledgers, matrices, source trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragweave.operators.ledger import last_wins

from .store import listed, read_json

#: The names an id may have, the first that is present counts.
IDS = ["_id", "id", "docid", "query_id"]
#: Files of a ledger that name the folder of its rows; the last one counts. Readers of the ledger's own folder skip them.
POINTER = "_rows-"


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, text, title, metadata, line_no) of JSON lines; blank lines are skipped, malformed ones fail.

    line_no has the split in its upper bits and the place among the split's records below; ledger.dense() closes the gaps. The id is the value of the first of IDS that is present, even if it is null (then the text "None", as every null
    value of id, title and text). metadata: the other keys as JSON, the id among them.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.monotonically_increasing_id().alias("line_no"))
    rows = lines.select(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"}).alias("m"), F.parse_json("value").alias("j"), "line_no")
    has = lambda k: F.array_contains(F.map_keys("m"), k)
    value = lambda k: F.coalesce(F.element_at("m", F.lit(k)), F.lit("None"))
    rid = F.raise_error(F.lit("record without an id")).cast("string")
    for k in reversed(IDS):
        rid = F.when(has(k), value(k)).otherwise(rid)
    text, title = (F.when(has(k), value(k)).otherwise("") for k in ("text", "title"))
    whole = F.when(text == "", title).when((title != "") & ~F.contains(text, title), F.concat(title, F.lit("\n"), text)).otherwise(text)
    rest = F.to_json(F.map_filter(F.try_variant_get("j", "$", "map<string,variant>"), lambda k, _: ~k.isin("title", "text")))
    return rows.select(rid.alias("record_id"), whole.alias("text"), title.alias("title"), rest.alias("metadata"), "line_no")


def queries(spark: SparkSession, path: str) -> DataFrame:
    """corpus() with the last line of each id."""
    return last_wins(corpus(spark, path), ["record_id"], ["line_no"])


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, source_doc_id, score, ord) of a TSV file with a header; the last row of a pair wins, ord is its first place."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    pick = lambda *names: next((F.col(f"`{n}`") for n in names if n in raw.columns), F.lit(None))
    rows = raw.select(pick("query-id", "query_id", "qid").alias("query_id"), pick("corpus-id", "corpus_id", "docid").alias("source_doc_id"), pick("score", "relevance").cast("int").alias("score"), F.monotonically_increasing_id().alias("line_no"))
    return rows.groupBy("query_id", "source_doc_id").agg(F.max_by("score", "line_no").alias("score"), F.min("line_no").alias("ord"))


def nested_results(spark: SparkSession, path: str, row: str) -> DataFrame:
    """(key, ordinal, fields of `row`) of a list of maps of lists of objects; levels that are something else are skipped.

    A file that is not a list is an error. Keys come in no order; a key's rows keep theirs.
    """
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("j"))
    outer = F.try_variant_get("j", "$", "array<variant>")
    listed = raw.select(F.explode(F.when(outer.isNotNull(), outer).otherwise(F.raise_error(F.lit("not a list of results")).cast("array<variant>"))).alias("m"))
    keyed = listed.select(F.explode(F.try_variant_get("m", "$", "map<string,variant>")).alias("key", "v"))
    rows = keyed.select("key", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("ordinal", "r")).where(F.startswith(F.schema_of_variant("r"), F.lit("OBJECT")))
    return rows.select("key", "ordinal", F.from_json(F.to_json("r"), f"struct<{row}>").alias("r")).select("key", "ordinal", "r.*")


def blackbox_samples(rows: DataFrame, dataset: str) -> DataFrame:
    """(sample_id, query_id, query, target_answer, text, payload_start) of injected texts that begin with their query and go on."""
    each = rows.select(F.col("id").alias("query_id"), F.col("question").alias("query"), F.col("incorrect_answer").alias("target_answer"), F.posexplode("injected_adv").alias("ordinal", "text"))
    kept = each.where((F.col("query") != "") & F.startswith("text", F.col("query")))
    rest = F.regexp_replace(F.substring("text", F.length("query") + 1, F.length("text")), r"^[. \t\n]+", "")
    kept = kept.withColumn("payload_start", F.length("text") - F.length(rest)).where(F.col("payload_start") < F.length("text"))
    return kept.withColumn("sample_id", F.substring(F.sha2(F.concat(F.lit(f"{dataset}\0"), "query_id", F.lit("\0"), "text"), 256), 1, 24))


def home(spark: SparkSession, path: str) -> str:
    """The folder that holds a ledger's rows: the one that its last pointer names, or its own."""
    pointers = [n for n in listed(spark, path) if n.startswith(POINTER) and not n.endswith(".part")]
    return f"{path}/{read_json(spark, f'{path}/{pointers[-1]}')['rows']}" if pointers else path


def ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON-line files with their file and place, which together are ledger order."""
    lines = spark.read.text(home(spark, path)).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no")).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), "file", "line_no").select("r.*", "file", "line_no")


def matrix(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(file, row, vec) of raw little-endian float32 files; a file that ends inside a row fails."""

    def rows(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                view = np.frombuffer(data.as_buffer(), "<f4")
                if len(data.as_buffer()) % (4 * dim):
                    raise ValueError(f"partial row in {name}")
                x = view.reshape(-1, dim)
                for at in range(0, len(x), 65536):
                    part = x[at : at + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(list(part), pa.list_(pa.float32()))], names=["file", "row", "vec"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "file string, row long, vec array<float>")
