"""Readers and writers of documents, predictions, generations, ledgers and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia import schemas


def _checked(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Parse JSON lines strictly: a bad line or an unknown field fails the job."""
    known = F.array(*[F.lit(f.name) for f in schema.fields])
    extra = F.array_except(F.json_object_keys("value"), known)
    bad = F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(extra, ", ")))
    body = F.when(F.size(extra) > 0, bad.cast("string")).otherwise(F.col("value"))
    parsed = F.from_json(body, schema, {"mode": "FAILFAST"})
    return raw.filter(F.trim("value") != "").select(parsed.alias("r")).select("r.*")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents as JSON lines; blank lines are skipped, unknown fields refused."""
    return _checked(spark.read.text(path), schemas.DOCUMENT)


def write_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("error").option("ignoreNullFields", "false").json(path)


def write_corpora(docs: DataFrame, path: str) -> None:
    """Documents under ``corpus=.../split=...``, so that readers of one split open its folder alone."""
    docs.write.mode("error").partitionBy("corpus", "split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str, corpus: str | None = None) -> DataFrame:
    """One split of a document table partitioned by ``split``: other folders are not read.

    With ``corpus`` the table is also partitioned by it, and a corpus that is not there is an error.
    """
    docs = spark.read.parquet(path)
    if corpus is None:
        return docs.filter(F.col("split") == split)
    mine = docs.filter(F.col("corpus") == corpus)
    if mine.isEmpty():
        raise FileNotFoundError(f"no corpus {corpus} in {path}")
    return mine.filter(F.col("split") == split)


def flatten(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components, relations) of nested documents."""
    comps = docs.select("doc_id", F.posexplode("components").alias("idx", "c")).select(
        "doc_id", F.col("idx").cast("bigint").alias("idx"), F.col("c.id").alias("comp_id"),
        F.col("c.type").alias("ctype"), F.col("c.start").alias("start_off"),
        F.col("c.end").alias("end_off"), F.col("c.text").alias("text"), F.col("c.stance").alias("stance"),
    )
    rels = docs.select("doc_id", F.posexplode("relations").alias("idx", "r")).select(
        "doc_id", F.col("idx").cast("bigint").alias("idx"), F.col("r.id").alias("rel_id"),
        F.col("r.src").alias("src"), F.col("r.tgt").alias("tgt"), F.col("r.type").alias("rtype"),
    )
    return comps, rels


def read_split_ids(spark: SparkSession, path: str) -> DataFrame:
    """(split, doc_id) of ``{train: [], val: [], test: []}`` objects, one a line or one a file."""
    ids = T.ArrayType(T.StringType())
    schema = T.StructType([T.StructField(s, ids) for s in schemas.SPLITS])
    lists = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    entries = F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("ids")) for s in schemas.SPLITS])
    return lists.select(F.inline(entries)).select("split", F.explode("ids").alias("doc_id"))


def write_split_ids(docs: DataFrame, path: str, most: int = 100_000) -> None:
    """Sorted id lists, without any text, as ``{train: [], val: [], test: []}`` files.

    A file holds about ``most`` ids, a range of the sorted ids; a small corpus is one file.
    """
    n = docs.count()
    ranged = docs.select("split", "doc_id").repartitionByRange(max(1, -(-n // most)), "doc_id")
    part = F.spark_partition_id().alias("part")
    mine = lambda s: F.array_sort(F.collect_list(F.when(F.col("split") == s, F.col("doc_id")))).alias(s)
    lists = ranged.groupBy(part).agg(*map(mine, schemas.SPLITS)).repartition("part").sortWithinPartitions("part")
    body = F.to_json(F.struct(*schemas.SPLITS), {"ignoreNullFields": "false"})
    lists.select("part", body.alias("value")).write.mode("error").partitionBy("part").text(path)


def read_ledger(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Spend ledger lines. Tolerant mode skips broken lines and takes missing dollars as 0."""
    if strict:
        return spark.read.schema(schemas.LEDGER).option("mode", "FAILFAST").json(path)
    return tolerant_ledger(spark.read.text(path))


def tolerant_ledger(lines: DataFrame) -> DataFrame:
    """Ledger rows of text lines (``value``); what does not parse is left out."""
    row = F.from_json("value", schemas.LEDGER)
    whole = lines.filter(F.try_parse_json("value").isNotNull()).select(row.alias("r")).select("r.*")
    return whole.withColumn("dollars", F.coalesce("dollars", F.lit(0.0)))


def ledger_rows(entries: DataFrame) -> DataFrame:
    """Entries as written: dollars to 6 places, latency to 4, the time filled in."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    stamp = F.when(F.coalesce("timestamp", F.lit("")) == "", now).otherwise(F.col("timestamp"))
    return entries.withColumns(
        {
            "timestamp": stamp,
            "dollars": F.bround("dollars", 6),
            "latency_s": F.bround("latency_s", 4),
            "note": F.coalesce("note", F.lit("")),
        }
    ).select([f.name for f in schemas.LEDGER.fields])


def append_ledger(entries: DataFrame, path: str) -> None:
    ledger_rows(entries).write.mode("append").json(path)


def last_per_document(rows: DataFrame, order: str) -> DataFrame:
    """The last row of each document in file order."""
    value = F.struct(*[c for c in rows.columns if c != "doc_id"])
    return rows.groupBy("doc_id").agg(F.max_by(value, order).alias("r")).select("doc_id", "r.*")


def read_predictions(spark: SparkSession, folder: str, stem: str) -> DataFrame:
    """Predictions of the newest file beginning with ``stem``; the last line of a document wins.

    The newest file is found in the listing, by time and name, and read alone. Lines are
    ordered by the place where Spark's reader met them in that file.
    """
    listing = spark.read.format("binaryFile").load(f"{folder}/{stem}*.jsonl").select("path", "modificationTime")
    newest = listing.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first().path
    lines = spark.read.text(newest).select(
        "value", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line")
    )
    rows = lines.filter(F.trim("value") != "")
    parsed = rows.select(F.from_json("value", schemas.PREDICTION, {"mode": "FAILFAST"}).alias("r"), "line")
    return last_per_document(parsed.select("r.*", "line"), "line").drop("line")


def write_predictions(preds: DataFrame, path: str) -> None:
    """Predictions in document order under their system and prompt version."""
    preds.sortWithinPartitions("doc_id").write.mode("append").partitionBy(
        "system", "prompt_version"
    ).json(path)


def read_generations(spark: SparkSession, path: str, single_run: bool = False) -> DataFrame:
    """One row per generated answer, with its run's adapter, seconds and constrained flag."""
    files = spark.read.schema(schemas.GENERATION_FILE).option("multiLine", True).json(path)
    return unnest_generations(files, single_run)


def unnest_generations(files: DataFrame, single_run: bool = False) -> DataFrame:
    many = F.raise_error(F.concat(F.lit("expected one run, found "), F.size("runs")))
    runs = F.when(F.size("runs") != 1, many).otherwise(F.col("runs")) if single_run else F.col("runs")
    flat = files.select("constrained", F.posexplode(runs.cast(T.ArrayType(schemas.RUN))).alias("run", "r"))
    return flat.select(
        "constrained", "run", F.coalesce("r.adapter", F.lit("base")).alias("adapter"),
        F.col("r.generate_seconds").alias("generate_seconds"), F.explode("r.results").alias("g"),
    ).select("constrained", "run", "adapter", "generate_seconds", "g.*")


def batched_throughput(generations: DataFrame) -> DataFrame:
    """Documents per second of every run."""
    n, s = F.count(F.lit(1)), F.max("generate_seconds")
    rate = F.when(s > 0, F.bround(n / s, 3)).otherwise(F.lit(0.0))
    return generations.groupBy("adapter").agg(n.alias("documents"), rate.alias("docs_per_second"))


def write_report(report: DataFrame, path: str) -> None:
    """A long-form report table."""
    report.write.mode("error").parquet(path)


def write_report_documents(scores: DataFrame, path: str) -> None:
    """One JSON document per model, as :func:`read_report` takes them.

    ``scores``: model, criterion, status, kind (components or relations), point. A criterion
    without a point has a status alone. A document holds a handful of criteria.
    """
    def part(kind: str) -> Column:
        point = F.max(F.when(F.col("kind") == kind, F.col("point")))
        return F.when(point.isNotNull(), F.struct(F.struct(point.alias("point")).alias("f1_ci"))).alias(kind)

    per = scores.groupBy("model", "criterion").agg(F.max("status").alias("status"), part("components"), part("relations"))
    entry = F.struct("criterion", F.struct("status", "components", "relations").alias("s"))
    documents = per.groupBy("model").agg(F.map_from_entries(F.collect_list(entry)).alias("scores"))
    body = F.to_json(F.struct("model", "scores"))
    documents.select(F.col("model").alias("file"), body.alias("value")).write.mode("error").partitionBy("file").text(path)


def report_json(report: DataFrame) -> DataFrame:
    """Report rows as JSON text, one per row."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("value"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Baseline report files as (model, criterion, status, kind, point)."""
    interval = "struct<point:double>"
    kinds = f"struct<status:string,components:struct<f1_ci:{interval}>,relations:struct<f1_ci:{interval}>>"
    files = spark.read.schema(f"model string, scores map<string,{kinds}>").option("multiLine", True).json(path)
    rows = files.select("model", F.explode("scores").alias("criterion", "s"))
    pair = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(f"s.{k}.f1_ci.point").alias("point")) for k in ("components", "relations")]
    )
    status = F.coalesce("s.status", F.lit("scored")).alias("status")
    return rows.select("model", "criterion", status, F.inline(pair))


def read_load_test(spark: SparkSession, path: str) -> DataFrame:
    """The aggregated row of a load-test statistics file; milliseconds become seconds."""
    rows = spark.read.option("header", True).csv(path)

    def number(col: str) -> Column:
        return F.coalesce(F.col(f"`{col}`").try_cast("double"), F.lit(0.0))

    def seconds(col: str, name: str) -> Column:
        return F.bround(number(col) / 1000, 3).alias(name)

    return rows.filter(F.col("Name") == "Aggregated").select(
        number("Request Count").cast("bigint").alias("requests"),
        number("Failure Count").cast("bigint").alias("failures"),
        F.bround(number("Requests/s"), 3).alias("throughput_rps"),
        seconds("50%", "p50_s"), seconds("95%", "p95_s"), seconds("99%", "p99_s"),
        seconds("Average Response Time", "mean_s"), seconds("Max Response Time", "max_s"),
    )


def write_exemplars(exemplars: DataFrame, path: str) -> None:
    exemplars.select("doc_id", "source", "text", "graph").write.mode("error").json(path)


def read_exemplars(spark: SparkSession, path: str) -> DataFrame:
    """Exemplars as written; none where nothing was ever written."""
    schema = "doc_id string, source string, text string, graph string"
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_chat(records: DataFrame, path: str) -> None:
    """Chat records as JSON lines: (doc_id, messages)."""
    records.select(F.to_json(F.struct("doc_id", "messages")).alias("value")).write.mode("error").text(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file at the path, hashed in tasks. A file is one row, so at most 2 GB."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def audit_checksums(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, found, expected, status): ok, differs, missing or unexpected.

    ``found`` holds (name, sha256) of files that are there, ``expected`` what they should be.
    """
    mine, want = found.withColumnRenamed("sha256", "found"), expected.withColumnRenamed("sha256", "expected")
    status = (
        F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "unexpected")
        .when(F.col("found") == F.col("expected"), "ok").otherwise("differs")
    )
    return mine.join(want, "name", "full").select("name", "found", "expected", status.alias("status"))


def verify_checksum(spark: SparkSession, path: str, expected: str) -> None:
    """Fail unless every file at the path has the expected SHA-256."""
    wrong = checksums(spark, path).filter(F.col("sha256") != expected).select("path").limit(5).collect()
    if wrong:
        raise ValueError(f"checksum differs: {[r.path for r in wrong]}")
