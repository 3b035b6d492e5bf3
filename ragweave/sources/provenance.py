"""Hashes of files, trees and values, lock files, and the provenance of rows."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragweave.functions.ship import shipped

#: The version of rows that carry provenance, and the folders and endings of a source tree.
SCHEMA_VERSION = 2
SUFFIXES = [".py", ".yaml", ".yml", ".toml", ".md", ".txt", ".sh"]
SKIPPED = [".git", "__pycache__", ".pytest_cache", "hf-cache", "models", "datasets", "results", "phantom-results", "wandb"]


def canonical_json(value) -> str:
    """Sorted keys, no blanks, characters beyond ASCII as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def canonical_hash(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def _quoted(text: Column) -> Column:
    """A JSON string as canonical_json() writes it: quotes, backslashes and control characters are escaped, nothing else."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    plain = out
    for code in range(0x20):
        out = F.replace(out, F.lit(chr(code)), F.lit(json.dumps(chr(code))[1:-1]))
    return F.concat(F.lit('"'), F.when(F.rlike(text, F.lit("[\\x00-\\x1f]")), out).otherwise(plain), F.lit('"'))


def _native(kind: T.DataType) -> bool:
    """Whether canonical() has an expression for values of a type: numbers with a fraction have their own way of writing."""
    if isinstance(kind, T.StructType):
        return all(_native(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _native(kind.elementType)
    if isinstance(kind, T.MapType):
        return isinstance(kind.keyType, T.StringType) and _native(kind.valueType)
    return isinstance(kind, (T.StringType, T.IntegralType, T.BooleanType, T.NullType))


def _canonical(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = [F.concat(_quoted(F.lit(f.name)), F.lit(":"), _canonical(value.getField(f.name), f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.concat(F.lit("{"), F.array_join(F.array(*fields), ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: _canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(F.transform_values(value, lambda _, v: _canonical(v, kind.valueType))))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))
    elif isinstance(kind, T.StringType):
        out = _quoted(value)
    elif isinstance(kind, T.NullType):
        out = F.lit("null")
    else:
        out = value.cast("string")
    return F.when(value.isNull(), "null").otherwise(out)


def _plain(value):
    """A value of a row as canonical_json() takes it."""
    import numpy as np

    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, np.ndarray)):
        return [_plain(v) for v in value]
    return value.item() if isinstance(value, np.generic) else value


def _canonical_texts(column, parse: list[str]):
    import pyarrow as pa

    rows = []
    for row in column.to_pylist(maps_as_pydicts="strict"):
        rows.append(canonical_json({k: json.loads(v) if k in parse and v is not None else _plain(v) for k, v in row.items()}))
    return pa.array(rows, pa.string())


def canonical(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """rows with the canonical JSON of an object of `columns`, at any depth with sorted keys: canonical_json() of each row.

    Text, whole numbers, truth values, and lists, objects and maps of them are written by expressions; where numbers with
    a fraction or variants are among them, by Arrow batch with canonical_json() itself.
    """
    kinds = {f.name: f.dataType for f in rows.select(*columns).schema.fields}
    whole = T.StructType([T.StructField(c, k) for c, k in kinds.items()])
    if _native(whole):
        return rows.withColumn(name, _canonical(F.struct(*(F.col(c) for c in columns)), whole))
    variants = [c for c, k in kinds.items() if isinstance(k, T.VariantType)]
    texts = shipped(__name__, "_canonical_texts", variants)

    def written(column: pa.Array) -> pa.Array:
        return texts(column)

    return rows.withColumn(name, F.arrow_udf(written, "string")(F.struct(*((F.to_json(c) if c in variants else F.col(c)).alias(c) for c in columns))))


def row_hash(rows: DataFrame, columns: list[str], name: str = "hash") -> DataFrame:
    """rows with canonical_hash() of an object of `columns`."""
    return canonical(rows, columns, "__canonical").withColumn(name, F.sha2("__canonical", 256)).drop("__canonical")


def tree_files(spark: SparkSession, path: str, skipped: list[str] = (), suffixes: list[str] = ()) -> list[str]:
    """The files below a folder, by listing alone: folders named in `skipped` are not entered, and other endings not kept."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out, ahead = [], [where]
    while ahead:
        for f in store.listStatus(ahead.pop()):
            name = f.getPath().getName()
            if name in skipped:
                continue
            if f.isDirectory():
                ahead.append(f.getPath())
            elif not suffixes or name.endswith(tuple(suffixes)):
                out.append(f.getPath().toString())
    return sorted(out)


def file_hashes(spark: SparkSession, path: str, skipped: list[str] = (), suffixes: list[str] = ()) -> DataFrame:
    """(path, digest) of the files of tree_files(), by their path within the folder; no other file is opened."""
    wanted = tree_files(spark, path, skipped, suffixes)
    if not wanted:
        return spark.createDataFrame([], "path string, digest string")
    root = "/" + path.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    files = spark.read.format("binaryFile").load(wanted)
    relative = F.substring_index(F.concat(F.lit("/"), F.regexp_replace("path", "^[a-z0-9+.-]+:/*", "")), root, -1)
    return files.select(relative.alias("path"), F.sha2("content", 256).alias("digest"))


def tree_hash(files: DataFrame) -> DataFrame:
    """(digest): the hash of all files by their path, NUL, digest and line end, in order of paths. One row for a tree's files."""
    line = lambda x: F.concat(x["path"], F.lit("\0"), x["digest"], F.lit("\n"))
    return files.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "digest"))), line), ""), 256).alias("digest"))


def content_hash(files: dict[str, str]) -> str:
    """tree_hash() of a small mapping of paths to digests."""
    return hashlib.sha256("".join(f"{k}\0{v}\n" for k, v in sorted(files.items())).encode()).hexdigest()


def lock(spark: SparkSession, folders: dict[str, str], revisions: dict[str, str]) -> dict:
    """{name: {revision, files, content_sha256}} of named folders; a folder without files, or without a revision, is an error."""
    out = {}
    for name, path in sorted(folders.items()):
        if name not in revisions:
            raise ValueError(f"no revision of {name}")
        files = {r["path"]: r["digest"] for r in file_hashes(spark, path, [".git"]).collect()}  # one row for each file of a pinned folder
        if not files:
            raise ValueError(f"no files of {name}")
        out[name] = {"revision": revisions[name], "files": files, "content_sha256": content_hash(files)}
    return out


def provenance(commit: str, revisions: dict[str, str], config: dict) -> dict[str, object]:
    """The fields that tell whether a row belongs to the current detector."""
    return {"schema_version": SCHEMA_VERSION, "detector_code_commit": commit, "model_revisions": canonical_json(dict(sorted(revisions.items()))), "pipeline_config_sha256": canonical_hash(config)}


def with_provenance(rows: DataFrame, fields: dict[str, object]) -> DataFrame:
    return rows.select("*", *(F.lit(v).alias(k) for k, v in fields.items()))


def seeded(name: str, seed: int) -> Column:
    """A whole number below 2**28 for each row of a column, the same for the same seed in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(name).cast("string"))), 1, 7), 16, 10).cast("long")
