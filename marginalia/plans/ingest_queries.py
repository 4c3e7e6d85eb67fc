"""Files and formats: documents are written in each format by Spark and read back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia import fixtures as fx
from marginalia.fixtures import CTE
from marginalia.functions import text as tx
from marginalia.operators import shaping as sh
from marginalia.plans.answer_queries import _gold_text
from marginalia.plans.registry import query
from marginalia.plans.shaping_queries import PROMPT_SQL, SYSTEM, _graphs
from marginalia.session import cut, scratch_path
from marginalia.sources import arggraph as ag
from marginalia.sources import files, snapshots, standoff
from marginalia.streaming import jobs


def _nested(spark: SparkSession, sf: str) -> DataFrame:
    """Annotated documents as one nested row each."""
    docs = fx.docs(spark, sf)
    comp = F.struct(
        F.col("comp_id").alias("id"), F.col("ctype").alias("type"), F.col("start_off").alias("start"),
        F.col("end_off").alias("end"), "text", F.lit(None).cast("string").alias("stance"),
    )
    rel = F.struct(F.col("rel_id").alias("id"), "src", "tgt", F.col("rtype").alias("type"))

    def listed(df: DataFrame, item, name: str) -> DataFrame:
        rows = df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", item.alias("x")))).alias(name))
        return rows.select("doc_id", F.col(f"{name}.x").alias(name))

    def some(name: str):
        return F.coalesce(F.col(name), F.filter(name, lambda x: F.lit(False)), F.from_json(F.lit("[]"), kinds[name]))

    kinds = {"components": files.schemas.DOCUMENT["components"].dataType, "relations": files.schemas.DOCUMENT["relations"].dataType}
    return (
        docs.join(listed(_gold_text(spark, sf), comp, "components"), "doc_id", "left")
        .join(listed(fx.gold_rel(spark, sf), rel, "relations"), "doc_id", "left")
        .select(
            F.col("doc_id").cast("string").alias("doc_id"), F.lit("essays").alias("source"), "split", "text",
            some("components").alias("components"), some("relations").alias("relations"),
            F.create_map(F.lit("lang"), "lang").alias("meta"),
        )
    )


@query(
    "a1_document_lines",
    """SELECT doc_id::VARCHAR AS doc_id, split, sha256(text) AS text, (SELECT count(*) FROM fx_gold g WHERE g.doc_id = d.doc_id) AS n_components
FROM fx_docs d""",
    ("fx_docs", "fx_gold"),
)
def a1_document_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as JSON lines and read back under the closed schema."""
    path = scratch_path(spark, "documents")
    files.write_documents(_nested(spark, sf), path)
    docs = files.read_documents(spark, path)
    n = F.size("components").cast("bigint")
    return docs.select("doc_id", "split", F.sha2("text", 256).alias("text"), n.alias("n_components"))


@query(
    "a2_flattened_documents",
    "SELECT doc_id::VARCHAR AS doc_id, idx, comp_id, ctype, start_off, end_off FROM fx_gold",
    ("fx_gold",),
)
def a2_flattened_documents(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "documents")
    files.write_documents(_nested(spark, sf), path)
    components, _ = files.flatten(files.read_documents(spark, path))
    return components.drop("text", "stance")


# ---- standoff ---------------------------------------------------------------------------
# what tx.LINE_BREAK can match, as the inside of a character class
BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"


def _one_line(spark: SparkSession, sf: str) -> DataFrame:
    """Every gold span from its first character that breaks no line to the next break.

    A span of line breaks alone has no text to record and is the one kind left out.
    """
    lead = F.length(F.regexp_extract("text", f"^[{BREAKS}]*", 0))
    body = F.regexp_extract("text", f"^[{BREAKS}]*([^{BREAKS}]*)", 1)
    rows = _gold_text(spark, sf).withColumn("start_off", F.col("start_off") + lead).withColumn("text", body)
    return rows.withColumn("end_off", F.col("start_off") + F.length("text")).filter("text <> ''")


def standoff_docs(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text, ann): annotation lines of every document, empty where it has no span.

    Written once, since lines are read several times over.
    """
    k = F.col("idx")
    rows = _one_line(spark, sf)
    at = F.concat_ws(" ", "start_off", "end_off")
    broken = F.concat(at, F.lit(";"), at)
    span = F.concat(
        "comp_id", F.lit("\t"), "ctype", F.lit(" "), F.when(k % 13 == 12, broken).otherwise(at), F.lit("\t"),
        "text", F.when(k % 4 == 1, "\t").otherwise(""),
    )
    stance = F.when(
        F.col("ctype") == "Claim",
        F.concat(F.lit("A"), k + 1, F.lit("\tStance "), "comp_id", F.lit(" "), F.when(k % 2 == 0, "For").otherwise("Against")),
    )
    edge = F.when(
        k >= 1,
        F.concat(F.lit("R"), k, F.lit("\tsupports Arg1:"), "comp_id", F.lit(" Arg2:T"), F.when(k % 3 == 0, 1).otherwise(k), F.lit("\t")),
    )
    lines = rows.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", F.concat_ws("\n", span, stance, edge).alias("l")))).alias("x")
    )
    ann = lines.select("doc_id", F.concat(F.array_join("x.l", "\n"), F.lit("\n")).alias("ann"))
    return cut(fx.dealt_texts(spark, sf).join(ann, "doc_id", "left").withColumn("ann", F.coalesce("ann", F.lit(""))))


CTE["fx_oneline"] = (
    ("fx_gold",),
    f"""SELECT doc_id, idx, comp_id, ctype, start_off + lead AS start_off, start_off + lead + length(body) AS end_off, body AS t FROM (
  SELECT g.*, length(regexp_extract(t, '^[{BREAKS}]*')) AS lead, regexp_extract(t, '^[{BREAKS}]*([^{BREAKS}]*)', 1) AS body
  FROM (SELECT g.*, substr(text, start_off + 1, end_off - start_off) AS t FROM fx_gold g JOIN documents USING (doc_id)) g) WHERE body <> ''""",
)


@query(
    "a3_standoff_components",
    """SELECT doc_id, comp_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_off, end_off, comp_id) - 1 AS idx, ctype, start_off, end_off, CASE WHEN ctype = 'Claim' THEN CASE WHEN idx % 2 = 0 THEN 'For' ELSE 'Against' END END AS stance,
  CASE WHEN idx % 4 = 1 THEN 'fixup' ELSE 'same' END AS "check" FROM fx_oneline WHERE idx % 13 <> 12""",
    ("fx_oneline",),
)
def a3_standoff_components(spark: SparkSession, sf: str) -> DataFrame:
    components, _, _ = standoff.parse_annotations(standoff_docs(spark, sf))
    return components.select("doc_id", "comp_id", "idx", "ctype", "start_off", "end_off", "stance", "check")


@query(
    "a3_standoff_relations",
    """SELECT doc_id, concat('R', idx) AS rel_id, 'supports' AS rtype, comp_id AS src, concat('T', goal) AS tgt
FROM (SELECT *, CASE WHEN idx % 3 = 0 THEN 1 ELSE idx END AS goal FROM fx_oneline WHERE idx >= 1 AND idx % 13 <> 12) e
WHERE NOT EXISTS (SELECT 1 FROM fx_oneline o WHERE o.doc_id = e.doc_id AND o.idx = e.goal - 1 AND o.idx % 13 = 12)""",
    ("fx_oneline",),
)
def a3_standoff_relations(spark: SparkSession, sf: str) -> DataFrame:
    _, edges, _ = standoff.parse_annotations(standoff_docs(spark, sf))
    return edges.select("doc_id", "rel_id", "rtype", "src", "tgt")


@query(
    "b5_offset_fixups",
    """SELECT doc_id, count(*) FILTER (idx % 4 = 1) AS fixups, count(*) FILTER (idx % 4 = 3) AS drifts FROM fx_oneline GROUP BY doc_id""",
    ("fx_oneline",),
)
def b5_offset_fixups(spark: SparkSession, sf: str) -> DataFrame:
    from marginalia.operators.validate import offset_check

    k = F.col("idx")
    rows = _one_line(spark, sf)
    declared = F.when(k % 4 == 1, F.concat("text", F.lit("\t"))).when(k % 4 == 3, F.concat("text", F.lit("x")))
    check = offset_check(F.col("text"), declared.otherwise(F.col("text")))
    return rows.select("doc_id", check.alias("c")).groupBy("doc_id").agg(
        F.count_if(F.col("c") == "fixup").alias("fixups"), F.count_if(F.col("c") == "drift").alias("drifts")
    )


@query(
    "a4_archive_members",
    "SELECT doc_id::VARCHAR AS doc_id, sha256(text) AS text FROM documents",
)
def a4_archive_members(spark: SparkSession, sf: str) -> DataFrame:
    """Every document packed into an archive of its own, opened and paired again."""

    def pack(frames):
        for frame in frames:
            rows = []
            for doc_id, text, ann in zip(frame["doc_id"], frame["text"], frame["ann"]):
                inner, outer = io.BytesIO(), io.BytesIO()
                with zipfile.ZipFile(inner, "w") as z:
                    z.writestr("project/", "")
                    z.writestr(f"project/{doc_id}.txt", text.encode())
                    z.writestr(f"project/{doc_id}.ann", ann.encode())
                    z.writestr(f"__MACOSX/project/._{doc_id}.txt", b"fork")
                with zipfile.ZipFile(outer, "w") as z:
                    z.writestr("corpus/project.zip", inner.getvalue())
                rows.append((f"{doc_id}.zip", outer.getvalue()))
            yield pd.DataFrame(rows, columns=["path", "content"])

    packed = standoff_docs(spark, sf).mapInPandas(pack, "path string, content binary")
    # written once: texts and annotations are looked for apart
    pairs = standoff.pair_members(cut(standoff.archive_members(packed)))
    return pairs.select("doc_id", F.sha2("text", 256).alias("text"))


@query(
    "c13_paired_files",
    """SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS paired FROM documents""",
)
def c13_paired_files(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.table(spark, sf, "documents").select("doc_id")
    lone = standoff.unpaired(docs, fx.table(spark, sf, "labels").select("doc_id")).withColumn("paired", F.lit(False))
    return docs.join(lone, "doc_id", "left").withColumn("paired", F.coalesce("paired", F.lit(True)))


@query(
    "a6_split_csv",
    """SELECT concat('doc;', doc_id) AS doc_id, CASE WHEN doc_id % 4 = 0 THEN 'train' WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM documents""",
)
def a6_split_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Split files of a hundred documents each, with header, byte-order mark and quoted delimiters."""
    d = F.col("doc_id")
    docs = fx.table(spark, sf, "documents").select("doc_id")
    row = F.concat(F.lit('"doc;'), d, F.lit('";"'), F.when(d % 3 == 0, "TEST").otherwise("Train"), F.lit('"'))
    lines = docs.filter(d % 4 != 0).groupBy(F.floor(d / 100).alias("part")).agg(F.array_sort(F.collect_list(row)).alias("l"))
    mark = F.when(F.col("part") % 2 == 0, "\ufeff").otherwise("")
    made = lines.select(F.concat(mark, F.lit('"ID";"SET"\r\n'), F.array_join("l", "\r\n"), F.lit("\r\n")).alias("value"))
    path = scratch_path(spark, "splits")
    made.repartition(F.xxhash64("value")).write.option("lineSep", "\u0000").text(path)
    read = spark.read.option("lineSep", "\u0000").text(path).filter("value <> ''")
    splits = standoff.read_split_csv(read.select(F.lit(path).alias("path"), "value"))
    return standoff.with_split(docs.select(F.concat(F.lit("doc;"), d).alias("doc_id")), splits)


@query("a7_split_ids", "SELECT split, doc_id::VARCHAR AS doc_id FROM fx_docs", ("fx_docs",))
def a7_split_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Id lists written and read back by the library's own writer and reader."""
    path = scratch_path(spark, "splits")
    docs = fx.docs(spark, sf).withColumn("doc_id", F.col("doc_id").cast("string"))
    files.write_split_ids(docs, path)
    return files.read_split_ids(spark, path)


def _ledger_entries(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.ledger(spark, sf)
    return rows.select(
        F.when(F.col("event_id") % 10 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("").alias("timestamp"),
        "model", F.col("doc_id").cast("string").alias("doc_id"), "input_tokens", "output_tokens", "cache_read_tokens",
        "cache_write_tokens", "dollars", (F.col("latency_ms") / 1000).alias("latency_s"), "batch", "cached",
        F.lit(None).cast("string").alias("note"),
    )


LEDGER_SQL = """SELECT model, count(*) AS calls, round_even(sum(round_even(dollars, 6)::DECIMAL(38,12))::DOUBLE, 6) AS dollars FROM fx_ledger {where} GROUP BY model"""


@query("a8_tolerant_ledger", LEDGER_SQL.format(where="WHERE event_id % 13 <> 0"), ("fx_ledger",))
def a8_tolerant_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Broken lines in the ledger are skipped."""
    from marginalia.operators.cost import exact_sum

    rows = fx.ledger(spark, sf)
    body = F.to_json(F.struct("model", F.bround("dollars", 6).alias("dollars")))
    line = F.when(F.col("event_id") % 13 == 0, F.substring(body, F.lit(1), F.length(body) - 3)).otherwise(body)
    got = files.tolerant_ledger(rows.select(line.alias("value")))
    return got.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.bround(exact_sum(F.col("dollars")), 6).alias("dollars"))


@query("a9_ledger_append", LEDGER_SQL.format(where=""), ("fx_ledger",))
def a9_ledger_append(spark: SparkSession, sf: str) -> DataFrame:
    from marginalia.operators.cost import exact_sum

    path = scratch_path(spark, "ledger")
    entries = _ledger_entries(spark, sf)
    even = F.col("input_tokens") % 2 == 0
    files.append_ledger(entries.filter(even), path)
    files.append_ledger(entries.filter(~even), path)
    got = files.read_ledger(spark, path, strict=True)
    return got.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.bround(exact_sum(F.col("dollars")), 6).alias("dollars"))


@query(
    "a10_last_prediction_wins",
    "SELECT doc_id, max(event_id) AS line, max_by(answer, event_id) AS answer FROM fx_gen GROUP BY doc_id",
    ("fx_gen",),
)
def a10_last_prediction_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.gen(spark, sf).select("doc_id", F.col("event_id").alias("line"), "answer")
    return files.last_per_document(rows, "line")


@query(
    "a11_predictions_sink",
    "SELECT concat('s', system_id) AS system, 'v2' AS prompt_version, count(*) AS n FROM fx_pred GROUP BY system_id",
    ("fx_pred",),
)
def a11_predictions_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "predictions")
    preds = fx.pred(spark, sf).select(
        F.concat(F.lit("s"), "system_id").alias("system"), F.lit("v2").alias("prompt_version"), "doc_id", "comp_id"
    )
    files.write_predictions(preds, path)
    back = spark.read.schema("doc_id bigint, comp_id string, system string, prompt_version string").json(path)
    return back.groupBy("system", "prompt_version").agg(F.count(F.lit(1)).alias("n"))


CTE["fx_version"] = (
    ("fx_pred",),
    """SELECT concat('s', system_id) AS system, 'v' || v AS prompt_version, doc_id, comp_id, n AS version
FROM fx_pred, (VALUES (1, 1), (1, 2), (2, 3)) t(v, n)
WHERE CASE n WHEN 1 THEN true WHEN 2 THEN system_id = 0 AND idx % 2 = 0 ELSE system_id = 1 END""",
)


def _versions(spark: SparkSession, sf: str) -> tuple[str, T.StructType]:
    """A prediction table written three times: all, one system anew, another prompt version."""
    folder = scratch_path(spark, "versions")
    pred = fx.pred(spark, sf)
    named = pred.select(F.concat(F.lit("s"), "system_id").alias("system"), "doc_id", "comp_id", "idx", "system_id")
    for prompt, rows in (
        ("v1", named),
        ("v1", named.filter("system_id = 0 AND idx % 2 = 0")),
        ("v2", named.filter("system_id = 1")),
    ):
        made = rows.select("system", F.lit(prompt).alias("prompt_version"), "doc_id", "comp_id")
        snapshots.commit(made, folder)
    return folder, made.schema


@query(
    "a10_newest_predictions",
    """SELECT doc_id, comp_id, version FROM fx_version WHERE (system, prompt_version, version) IN
  (SELECT (system, prompt_version, max(version)) FROM fx_version GROUP BY system, prompt_version) AND system = 's0'""",
    ("fx_version",),
)
def a10_newest_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """One system's predictions from the newest version that holds it."""
    folder, schema = _versions(spark, sf)
    return snapshots.latest(spark, folder, schema, system="s0").select("doc_id", "comp_id", "version")


@query(
    "a11_prediction_history",
    """SELECT system, prompt_version, version, count(*) AS n, count(DISTINCT doc_id) AS documents, sum(hash_part)::BIGINT AS content,
  version = max(version) OVER (PARTITION BY system, prompt_version) AS newest
FROM (SELECT *, ('0x' || substr(md5(concat_ws('|', system, prompt_version, doc_id, comp_id)), 1, 8))::BIGINT AS hash_part FROM fx_version)
GROUP BY system, prompt_version, version""",
    ("fx_version",),
)
def a11_prediction_history(spark: SparkSession, sf: str) -> DataFrame:
    """Every version as it was written, and which of them the view of the latest shows."""
    folder, schema = _versions(spark, sf)
    part = F.conv(F.substring(F.md5(F.concat_ws("|", "system", "prompt_version", F.col("doc_id").cast("string"), "comp_id")), 1, 8), 16, 10)
    every = snapshots.history(spark, folder, schema).groupBy("system", "prompt_version", "version").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"), F.sum(part.cast("bigint")).alias("content")
    )
    shown = snapshots.latest(spark, folder, schema).select("system", "prompt_version", "version", F.lit(True).alias("shown")).distinct()
    joined = every.join(shown, ["system", "prompt_version", "version"], "left")
    return joined.select(*every.columns, F.col("shown").isNotNull().alias("newest"))


@query(
    "a12_generations",
    """SELECT doc_id::VARCHAR AS doc_id, model AS adapter, sha256(answer) AS answer, output_tokens, 12.5::DOUBLE AS generate_seconds, true AS constrained
FROM fx_gen""",
    ("fx_gen",),
)
def a12_generations(spark: SparkSession, sf: str) -> DataFrame:
    """Generation files of one run per adapter and thousand answers, written, read and unnested."""
    path = scratch_path(spark, "generations")
    _generation_files(spark, sf).write.partitionBy("file").text(path)
    found = files.read_generations(spark, path, single_run=True)
    return found.select("doc_id", "adapter", F.sha2("text", 256).alias("answer"), "output_tokens", "generate_seconds", "constrained")


def _generation_files(spark: SparkSession, sf: str) -> DataFrame:
    item = F.struct(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("answer").alias("text"), "output_tokens",
        F.lit(0).cast("bigint").alias("prompt_tokens"), "finish_reason",
        F.lit(None).cast("double").alias("mean_logprob"), F.lit(None).cast("double").alias("min_logprob"),
    )
    # runs of bounded size: their number grows with the table
    part = F.floor(F.col("event_id") / 1000)
    runs = fx.gen(spark, sf).groupBy("model", part.alias("part")).agg(F.collect_list(item).alias("results"))
    run = F.struct(
        F.col("model").alias("adapter"), F.lit(12.5).alias("generate_seconds"), F.size("results").cast("bigint").alias("documents"),
        F.lit(None).cast("double").alias("throughput_docs_per_second"), "results",
    )
    body = F.to_json(F.struct(F.lit(True).alias("constrained"), F.array(run).alias("runs")))
    return runs.select(F.concat_ws("-", "model", "part").alias("file"), body.alias("value"))


@query(
    "a12_throughput",
    """SELECT model AS adapter, count(*) AS documents, round_even(count(*) / 12.5::DOUBLE, 3) AS docs_per_second FROM fx_gen GROUP BY model""",
    ("fx_gen",),
)
def a12_throughput(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "generations")
    _generation_files(spark, sf).write.partitionBy("file").text(path)
    return files.batched_throughput(files.read_generations(spark, path))


@query(
    "a13_report_sink",
    "SELECT lang, source, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang, source",
)
def a13_report_sink(spark: SparkSession, sf: str) -> DataFrame:
    """A long-form report written and read back."""
    path = scratch_path(spark, "report")
    report = fx.table(spark, sf, "documents").groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars")
    )
    files.write_report(report, path)
    return spark.read.schema(report.schema).parquet(path)


@query(
    "a13_report_documents",
    """SELECT source AS model, lang AS criterion, CASE WHEN count(*) > 3 THEN 'scored' ELSE 'few' END AS status,
  unnest(['components', 'relations']) AS kind,
  unnest([count(*) / 65536.0::DOUBLE, CASE WHEN count(*) > 3 THEN sum(n_chars % 7) / 65536.0::DOUBLE END]) AS point
FROM documents GROUP BY source, lang""",
)
def a13_report_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Scores written as one JSON document per model and read back."""
    path = scratch_path(spark, "report-documents")
    n, odd = F.count(F.lit(1)), F.sum(F.col("n_chars") % 7)
    rows = fx.table(spark, sf, "documents").groupBy(F.col("source").alias("model"), F.col("lang").alias("criterion")).agg(
        F.when(n > 3, "scored").otherwise("few").alias("status"), (n / F.lit(65536.0)).alias("c"),
        F.when(n > 3, odd / F.lit(65536.0)).alias("r"),
    )
    pair = [F.struct(F.lit(k).alias("kind"), F.col(c).alias("point")) for k, c in (("components", "c"), ("relations", "r"))]
    files.write_report_documents(rows.select("model", "criterion", "status", F.inline(F.array(*pair))), path)
    return files.read_report(spark, path).select("model", "criterion", "status", "kind", "point")


@query(
    "a14_report_scan",
    """SELECT source AS model, 'exact/untyped' AS criterion, 'scored' AS status, unnest(['components', 'relations']) AS kind,
  unnest([count(*) / 65536.0::DOUBLE, sum(n_chars % 7) / 65536.0::DOUBLE]) AS point FROM documents GROUP BY source
UNION ALL SELECT source, 'exact/typed', 'not_applicable', unnest(['components', 'relations']), NULL FROM documents GROUP BY source""",
)
def a14_report_scan(spark: SparkSession, sf: str) -> DataFrame:
    """One report file per source, some criteria of which do not apply."""
    path = scratch_path(spark, "reports")

    def part(value, name):
        return F.struct(F.struct(value.alias("point")).alias("f1_ci")).alias(name)

    figures = fx.table(spark, sf, "documents").groupBy("source").agg(
        (F.count(F.lit(1)) / F.lit(65536.0)).alias("c"), (F.sum(F.col("n_chars") % 7) / F.lit(65536.0)).alias("r")
    )
    scores = F.struct(
        F.struct(F.lit("not_applicable").alias("status")).alias("exact/typed"),
        F.struct(part(F.col("c"), "components"), part(F.col("r"), "relations")).alias("exact/untyped"),
    )
    body = F.to_json(F.struct(F.col("source").alias("model"), scores.alias("scores")))
    figures.select(F.col("source").alias("file"), body.alias("value")).write.partitionBy("file").text(path)
    return files.read_report(spark, path).select("model", "criterion", "status", "kind", "point")


@query(
    "a15_load_test_scan",
    """SELECT event_type AS level, count(*) AS requests, count(*) FILTER (event_id % 9 = 0) AS failures,
  round_even(max(event_id % 1000) / 1000.0::DOUBLE, 3) AS p50_s, round_even(max(event_id % 700) / 1000.0::DOUBLE, 3) AS p95_s,
  0.0::DOUBLE AS p99_s FROM events GROUP BY event_type""",
)
def a15_load_test_scan(spark: SparkSession, sf: str) -> DataFrame:
    """One statistics file per load level; a figure that is no number counts as 0."""
    path = scratch_path(spark, "load")
    e = F.col("event_id")
    rows = fx.table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("Request Count"), F.count_if(e % 9 == 0).alias("Failure Count"),
        F.max(e % 1000).alias("50%"), F.max(e % 700).alias("95%"),
    )
    both = rows.select(
        F.col("event_type").alias("level"), F.explode(F.array(F.lit("/x"), F.lit("Aggregated"))).alias("Name"),
        "Request Count", "Failure Count", F.lit(1.5).alias("Requests/s"), "50%", "95%", F.lit("N/A").alias("99%"),
        F.lit(1).alias("Average Response Time"), F.lit(2).alias("Max Response Time"),
    )
    both.write.option("header", True).partitionBy("level").csv(path)
    levels = [r[0] for r in rows.select("event_type").collect()]  # one per kind of event
    found = [files.read_load_test(spark, f"{path}/level={x}").withColumn("level", F.lit(x)) for x in levels]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("level", "requests", "failures", "p50_s", "p95_s", "p99_s")


@query(
    "a16_exemplar_files",
    "SELECT doc_id::VARCHAR AS doc_id, source, sha256(text) AS text, lang AS graph FROM documents",
)
def a16_exemplar_files(spark: SparkSession, sf: str) -> DataFrame:
    """Exemplars written and read back; a place without any gives none."""
    path = scratch_path(spark, "exemplars")
    rows = fx.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "source", "text", F.col("lang").alias("graph"))
    files.write_exemplars(rows, path)
    read = files.read_exemplars(spark, path).unionByName(files.read_exemplars(spark, f"{path}-absent"))
    return read.withColumn("text", F.sha2("text", 256))


@query(
    "a17_chat_lines",
    f"""SELECT doc_id, 3 AS turns, unnest(['system', 'user', 'assistant']) AS role,
  unnest([sha256('{SYSTEM}'), sha256({PROMPT_SQL}), sha256(graph)]) AS content FROM fx_graph""",
    ("fx_graph",),
)
def a17_chat_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "chat")
    chat = sh.messages(F.col("text"), F.to_json("graph"), SYSTEM)
    files.write_chat(_graphs(spark, sf).select("doc_id", chat.alias("messages")), path)
    back = spark.read.schema("doc_id bigint, messages array<struct<role:string,content:string>>").json(path)
    turns = F.size("messages").cast("bigint").alias("turns")
    return back.select("doc_id", turns, F.inline("messages")).withColumn("content", F.sha2("content", 256))


# ---- argument graphs ----------------------------------------------------------------------
def _edge_rule(k):
    """(type, target) of the edge of unit k+1; some chains, some dead ends, some circles."""
    prev = F.concat(F.lit("c"), k - 1)
    etype = (
        F.when(k % 24 == 22, "add").when(k % 24 == 23, "add").when(k % 17 == 16, "add")
        .when(k % 6 == 1, "sup").when(k % 6 == 2, "reb").when(k % 6 == 3, "und").when(k % 6 == 0, "exa").otherwise("add")
    )
    trg = (
        F.when(k % 24 == 22, F.concat(F.lit("c"), k + 1)).when(k % 24 == 23, prev).when(k % 17 == 16, "zz")
        .when(k % 6 == 1, "a1").when(k % 6 == 2, F.concat(F.lit("a"), k)).otherwise(prev)
    )
    return etype, trg


def _part():
    clean = F.regexp_replace("text", r"[^\x{20}-\x{d7ff}\x{e000}-\x{fffd}]", " ")
    return tx.strip(F.regexp_replace(clean, r"\]\]>", " "))


PART_SQL = r"""regexp_replace(regexp_replace(regexp_replace(substr(text, start_off + 1, end_off - start_off), '[^\x{20}-\x{d7ff}\x{e000}-\x{fffd}]', ' ', 'g'), '\]\]>', ' ', 'g'),
  '^[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')"""


def graph_xml(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("idx")
    etype, trg = _edge_rule(k)
    n = k + 1
    part = F.coalesce(F.nullif(_part(), F.lit("")), F.when(F.col("text").isNotNull(), "x"))
    edu = F.concat(F.lit('<edu id="e'), n, F.lit('"><![CDATA['), part, F.lit("]]></edu>"))
    adu = F.concat(F.lit('<adu id="a'), n, F.lit('" type="pro"/>'))
    seg = F.concat(F.lit('<edge id="s'), n, F.lit('" src="e'), n, F.lit('" trg="a'), n, F.lit('" type="seg"/>'))
    link = F.when(
        k >= 1,
        F.concat(F.lit('<edge id="c'), k, F.lit('" src="a'), n, F.lit('" trg="'), trg, F.lit('" type="'), etype, F.lit('"/>')),
    )
    rows = _gold_text(spark, sf).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", edu.alias("e"), adu.alias("a"), F.concat_ws("", seg, link).alias("l")))).alias("x")
    )
    body = F.concat(
        F.lit('<arggraph id="g" topic_id="t" stance="pro">'), F.array_join("x.e", ""), F.array_join("x.a", ""),
        F.array_join("x.l", ""), F.lit("</arggraph>"),
    )
    return rows.select("doc_id", body.alias("xml"))


def _parsed_graphs(spark: SparkSession, sf: str) -> DataFrame:
    """The parsed graphs, written once: segments, units and edges are taken from them apart."""
    return cut(ag.parse(graph_xml(spark, sf)))


CTE["fx_part"] = (
    ("fx_gold",),
    f"""SELECT doc_id, idx, CASE WHEN p = '' THEN 'x' ELSE p END AS part FROM (SELECT doc_id, idx, {PART_SQL} AS p FROM fx_gold JOIN documents USING (doc_id))""",
)
CTE["fx_unit_span"] = (
    ("fx_part",),
    """SELECT doc_id, idx, e - length(part) AS start_off, e AS end_off, part FROM (
  SELECT *, (sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY idx) - 1)::BIGINT AS e FROM fx_part)""",
)


@query(
    "a5_arggraph_components",
    "SELECT doc_id, concat('a', idx + 1) AS comp_id, 'pro' AS role, start_off, end_off, part AS text FROM fx_unit_span",
    ("fx_unit_span",),
)
def a5_arggraph_components(spark: SparkSession, sf: str) -> DataFrame:
    graphs = _parsed_graphs(spark, sf)
    docs, segments = ag.segment_text(graphs)
    spans = ag.unit_spans(ag.edges(graphs), segments)
    return ag.components(graphs, docs, spans).drop("ctype")


@query(
    "e3_segment_offsets",
    "SELECT doc_id, concat('e', idx + 1) AS edu_id, start_off, end_off FROM fx_unit_span",
    ("fx_unit_span",),
)
def e3_segment_offsets(spark: SparkSession, sf: str) -> DataFrame:
    _, segments = ag.segment_text(ag.parse(graph_xml(spark, sf)))
    return segments.select("doc_id", "edu_id", "start_off", "end_off")


CTE["fx_wide_unit"] = (
    ("fx_unit_span",),
    """SELECT doc_id, concat('a', idx // 3) AS adu_id, min(start_off) AS start_off, max(end_off) AS end_off FROM fx_unit_span GROUP BY doc_id, idx // 3""",
)


@query("c14_unit_spans", "SELECT * FROM fx_wide_unit", ("fx_wide_unit",))
def c14_unit_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Three segments to a unit."""
    graphs = _parsed_graphs(spark, sf)
    _, segments = ag.segment_text(graphs)
    number = F.substring("src", F.lit(2), F.length("src")).cast("int")
    joined = ag.edges(graphs).filter("etype = 'seg'").withColumn(
        "trg", F.concat(F.lit("a"), F.floor((number - 1) / 3))
    )
    return ag.unit_spans(joined, segments)


CTE["fx_edge"] = (
    ("fx_gold",),
    """SELECT doc_id, k, concat('c', k) AS edge_id, concat('a', k + 1) AS src,
  CASE WHEN k % 24 IN (22, 23) OR k % 17 = 16 THEN 'add' WHEN k % 6 = 1 THEN 'sup' WHEN k % 6 = 2 THEN 'reb' WHEN k % 6 = 3 THEN 'und' WHEN k % 6 = 0 THEN 'exa' ELSE 'add' END AS etype,
  CASE WHEN k % 24 = 22 THEN concat('c', k + 1) WHEN k % 24 = 23 THEN concat('c', k - 1) WHEN k % 17 = 16 THEN 'zz' WHEN k % 6 = 1 THEN 'a1'
       WHEN k % 6 = 2 THEN concat('a', k) ELSE concat('c', k - 1) END AS trg
FROM (SELECT doc_id, idx AS k FROM fx_gold WHERE idx >= 1)""",
)
CTE["fx_chain"] = (
    ("fx_edge",),
    """SELECT doc_id, k, edge_id AS at, etype AS at_type, trg, [edge_id] AS seen, false AS looped FROM fx_edge
UNION ALL
SELECT c.doc_id, c.k, c.trg, e.etype, e.trg, c.seen || [c.trg], list_contains(c.seen, c.trg) FROM fx_chain c
LEFT JOIN fx_edge e ON e.doc_id = c.doc_id AND e.edge_id = c.trg WHERE c.at_type = 'add' AND NOT c.looped""",
)
CTE["fx_resolved"] = (
    ("fx_chain",),
    """SELECT o.doc_id, o.edge_id, o.src, o.etype, CASE WHEN failed THEN NULL ELSE CASE WHEN at_type IN ('reb', 'und') THEN 'attacks' ELSE 'supports' END END AS rtype,
  CASE WHEN failed THEN NULL ELSE goal END AS tgt, CASE WHEN failed THEN len(seen) - (CASE WHEN at_type IS NULL AND NOT looped THEN 1 ELSE 0 END) ELSE 0 END AS noted
FROM (SELECT c.*, CASE WHEN starts_with(c.trg, 'a') THEN c.trg ELSE r.src END AS goal,
    c.looped OR c.at_type IS NULL OR CASE WHEN starts_with(c.trg, 'a') THEN c.trg ELSE r.src END IS NULL AS failed
  FROM fx_chain c LEFT JOIN fx_edge r ON r.doc_id = c.doc_id AND r.edge_id = c.trg
  WHERE c.looped OR c.at_type IS NULL OR c.at_type <> 'add') x JOIN fx_edge o ON o.doc_id = x.doc_id AND o.k = x.k""",
)


def _resolved(spark: SparkSession, sf: str):
    edges = cut(ag.edges(ag.parse(graph_xml(spark, sf))))
    units = edges.filter("etype = 'seg'").select("doc_id", F.col("trg").alias("adu_id"))
    return ag.resolve_edges(edges, units)


@query(
    "c15_resolved_edges",
    "SELECT doc_id, edge_id AS rel_id, src, tgt, rtype FROM fx_resolved WHERE tgt IS NOT NULL AND tgt <> src",
    ("fx_resolved",),
)
def c15_resolved_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf)[0].drop("pos")


@query(
    "c15_flattening_counts",
    """SELECT doc_id, count(*) FILTER (etype = 'und' AND tgt IS NOT NULL) AS undercuts_flattened, count(*) FILTER (etype = 'add' AND tgt IS NOT NULL) AS linked_premises_flattened,
  sum(CASE WHEN tgt = src THEN 1 ELSE noted END)::BIGINT AS unresolvable_edges FROM fx_resolved GROUP BY doc_id""",
    ("fx_resolved",),
)
def c15_flattening_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ag.flattening(_resolved(spark, sf)[1])


# ---- streams ------------------------------------------------------------------------------
@query(
    "j1_streaming_spend",
    """SELECT model, count(*) AS calls, round_even(sum(round_even(dollars, 6)::DECIMAL(38,12))::DOUBLE, 6) AS spent,
  sum(round_even(dollars, 6)::DECIMAL(38,12))::DOUBLE > 400 AS over_cap FROM fx_ledger GROUP BY model""",
    ("fx_ledger",),
)
def j1_streaming_spend(spark: SparkSession, sf: str) -> DataFrame:
    source = scratch_path(spark, "ledger")
    files.append_ledger(_ledger_entries(spark, sf), source)
    out = jobs.run_to_end(jobs.spend_by_model(jobs.read_ledger(spark, source), 400.0), "complete")
    return out


@query(
    "j2_streaming_distinct_calls",
    "SELECT model, count(DISTINCT doc_id) AS calls FROM fx_ledger GROUP BY model",
    ("fx_ledger",),
)
def j2_streaming_distinct_calls(spark: SparkSession, sf: str) -> DataFrame:
    """First calls by document and model, a batch per written file: old and undated rows in any of them."""
    source = scratch_path(spark, "ledger")
    entries = _ledger_entries(spark, sf)
    for part in range(3):
        files.append_ledger(entries.filter(F.col("input_tokens") % 3 == part).coalesce(1), source)
    once = jobs.first_calls(jobs.read_ledger(spark, source, files_per_batch=1), ["doc_id", "model"])
    return jobs.run_to_end(once, "append").groupBy("model").agg(F.count(F.lit(1)).alias("calls"))


@query(
    "j3_streaming_routing",
    f"""SELECT model, conf IS NULL OR conf < -0.01 AS escalated, count(*) AS documents, count(*) FILTER (NOT json_valid(answer) OR json_type(CASE WHEN json_valid(answer) THEN answer END) <> 'OBJECT') AS unparsed
FROM (SELECT g.*, CASE WHEN event_id % 37 = 0 THEN NULL ELSE -((event_id * 7919) % 1000)::DOUBLE / 50000::DOUBLE END AS conf FROM fx_gen g) GROUP BY ALL""",
    ("fx_gen",),
)
def j3_streaming_routing(spark: SparkSession, sf: str) -> DataFrame:
    source = scratch_path(spark, "generations")
    e = F.col("event_id")
    conf = F.when(e % 37 != 0, -((e * 7919) % 1000).cast("double") / F.lit(50000.0))
    fx.gen(spark, sf).withColumn("mean_logprob", conf).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    return jobs.run_to_end(jobs.route(stream, -0.01), "complete")


@query(
    "a18_checksum_audit",
    """SELECT lang || '-' || split || '-' || part AS name, found, expected, CASE WHEN found = expected THEN 'ok' ELSE 'differs' END AS status
FROM (SELECT lang, split, part, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id) || chr(10)) AS found,
    CASE WHEN lang = 'en' THEN sha256('') ELSE sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id) || chr(10)) END AS expected
  FROM (SELECT d.lang, f.split, f.doc_id, f.doc_id // 1000 AS part FROM fx_docs f JOIN documents d ON d.doc_id = f.doc_id)
  GROUP BY lang, split, part)""",
    ("fx_docs",),
)
def a18_checksum_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Files of sorted ids, at most 1,000 of a language and split, held against a list that is wrong for one language."""
    path = scratch_path(spark, "audited")
    lang = fx.table(spark, sf, "documents").select("doc_id", "lang")
    rows = fx.docs(spark, sf).select("doc_id", "split").join(lang, "doc_id")
    name = F.concat_ws("-", "lang", "split", F.expr("doc_id div 1000")).alias("name")
    lines = rows.groupBy(name, "lang").agg(
        F.concat(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), "\n"), F.lit("\n")).alias("body")
    )
    lines.select("name", F.expr("substr(body, 1, length(body) - 1)").alias("value")).write.partitionBy("name").text(path)
    right = F.when(F.col("lang") == "en", F.sha2(F.lit(""), 256)).otherwise(F.sha2("body", 256))
    named = files.checksums(spark, f"{path}/name=*").select(F.regexp_extract("path", "name=([^/]+)/", 1).alias("name"), "sha256")
    return files.audit_checksums(named, lines.select("name", right.alias("sha256")))
