"""Versioned prediction tables: every write is a version, a manifest says what it holds.

A version's rows are written first, under a folder of their own, and its manifest lines
afterwards; a write that fails leaves a folder no manifest names, which readers never see.
Versions are never changed. ``latest`` and ``history`` are views of the manifests: they
list folders from them and open only the folders they need.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("system", "prompt_version")


def manifest(spark: SparkSession, folder: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """``version, written, path, <keys>, n``: one row per version and key; empty before the first write."""
    schema = "version bigint, written timestamp, path string, " + ", ".join(f"`{k}` string" for k in keys) + ", n bigint"
    try:
        return spark.read.schema(schema).json(f"{folder}/manifest")
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def commit(rows: DataFrame, folder: str, keys: Sequence[str] = KEYS) -> int:
    """Write ``rows`` as the next version and return its number.

    Two writers may take the same number; their folders differ and the later one counts as newer.
    """
    spark = rows.sparkSession
    version = (manifest(spark, folder, keys).agg(F.max("version")).first()[0] or 0) + 1
    path = f"data/{version:08d}-{uuid.uuid4().hex}"
    rows.sortWithinPartitions("doc_id").write.partitionBy(*keys).json(f"{folder}/{path}")
    back = spark.read.schema(_as_text(rows.schema, keys)).json(f"{folder}/{path}")
    about = back.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(version).cast("bigint").alias("version"), F.current_timestamp().alias("written"), F.lit(path).alias("path"), *keys, "n"
    )
    # one small file per version, so that a version appears as a whole
    about.coalesce(1).write.mode("append").json(f"{folder}/manifest")
    return version


def _as_text(schema: T.StructType, keys: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType() if f.name in keys else f.dataType) for f in schema])


def _read(spark: SparkSession, folder: str, listed: DataFrame, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The folders of some manifest rows, with their version. The rows are one per version and key."""
    chosen = listed.select("version", "path", *keys).collect()
    parts = [
        spark.read.schema(schema)
        .option("basePath", f"{folder}/{path}")
        .json([f"{folder}/{path}/" + "/".join(f"{k}={r[k]}" for k in keys) for r in chosen if r.path == path])
        .withColumn("version", F.lit(version).cast("bigint"))
        for version, path in sorted({(r.version, r.path) for r in chosen})
    ]
    if not parts:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("version", T.LongType())]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def history(spark: SparkSession, folder: str, schema: T.StructType, keys: Sequence[str] = KEYS, **only: str) -> DataFrame:
    """Rows of all versions, with their ``version``. ``only`` names the keys wanted."""
    listed = manifest(spark, folder, keys)
    for key, value in only.items():
        listed = listed.filter(F.col(key) == value)
    return _read(spark, folder, listed, _as_text(schema, keys), keys)


def latest(spark: SparkSession, folder: str, schema: T.StructType, keys: Sequence[str] = KEYS, **only: str) -> DataFrame:
    """Rows of the newest version that holds each key."""
    listed = manifest(spark, folder, keys)
    for key, value in only.items():
        listed = listed.filter(F.col(key) == value)
    newest = W.partitionBy(*keys).orderBy(F.desc("version"), F.desc("written"), F.desc("path"))
    first = listed.withColumn("nth", F.row_number().over(newest)).filter("nth = 1")
    return _read(spark, folder, first, _as_text(schema, keys), keys)
