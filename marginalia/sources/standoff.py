"""Standoff annotation: archives, annotation lines, split lists."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.text import LINE_BREAK, SPACE, blocks, piece_of
from marginalia.operators.validate import offset_check
from marginalia.schemas import COMPONENT_TYPES, RELATION_TYPES, STANCES

# ---- fixed patterns of the format ------------------------------------------------
SPAN_LINE = r"(?s)^(T\d+)\t([A-Za-z_]+) ([\d ;]+)\t(.*)$"
EDGE_LINE = r"^(R\d+)\t([A-Za-z_]+) Arg1:(T\d+) Arg2:(T\d+)\s*$"
ATTRIBUTE_LINE = r"^(A\d+)\t([A-Za-z_]+) (T\d+) ([A-Za-z_]+)\s*$"
# -----------------------------------------------------------------------------------

# Opened members handed on at once.
BATCH_BYTES = 4 << 20


def archive_members(files: DataFrame) -> DataFrame:
    """(archive, member, content) of zip files ``(path, content)``, nested ones opened.

    Folders and resource forks are skipped. The unit of work is one archive; members go on
    in batches of a few MB.
    """

    def walk(name: str, data: bytes):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                member = info.filename
                if member.startswith("__MACOSX") or "/._" in member or member.startswith("._"):
                    continue
                if info.is_dir():
                    continue
                body = z.read(info)
                if member.endswith(".zip"):
                    yield from walk(f"{name}!{member}", body)
                else:
                    yield name, member, body

    def batch(frames):
        names = ["archive", "member", "content"]
        for frame in frames:
            rows, held = [], 0
            for path, content in zip(frame["path"], frame["content"]):
                for row in walk(path, content):
                    rows.append(row)
                    held += len(row[2])
                if held > BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(
        batch, "archive string, member string, content binary"
    )


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def pair_members(members: DataFrame) -> DataFrame:
    """Each document's text with its annotation, by file stem; an unpaired file fails."""
    named = members.withColumn("doc_id", stem(F.col("member")))

    def of(suffix: str, name: str) -> DataFrame:
        mine = named.filter(F.col("member").endswith(suffix))
        return mine.select("doc_id", F.decode("content", "UTF-8").alias(name))

    both = of(".txt", "text").join(of(".ann", "ann"), "doc_id", "full_outer")
    lone = F.raise_error(F.concat(F.lit("unpaired file: "), "doc_id"))
    whole = F.col("text").isNotNull() & F.col("ann").isNotNull()
    return both.withColumn("doc_id", F.when(whole, F.col("doc_id")).otherwise(lone.cast("string")))


def unpaired(texts: DataFrame, annotations: DataFrame) -> DataFrame:
    """Stems present on one side only."""
    return texts.exceptAll(annotations).union(annotations.exceptAll(texts))


def annotation_lines(docs: DataFrame) -> DataFrame:
    """One row per annotation line, read by kind: problems are named in ``error``."""
    line = F.col("line")
    rows = docs.select("doc_id", F.posexplode(F.split("ann", LINE_BREAK)).alias("pos", "line")).filter(
        line.rlike(f"[^{SPACE[1:-1]}]")
    )
    kind = F.substring(line, 1, 1)

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(line, pattern, i)

    span, edge, attr = (line.rlike(p) for p in (SPAN_LINE, EDGE_LINE, ATTRIBUTE_LINE))
    error = (
        F.when((kind == "T") & ~span, "unparseable T line")
        .when((kind == "R") & ~edge, "unparseable R line")
        .when((kind == "A") & ~attr, "unparseable A line")
        .when(~kind.isin("T", "R", "A"), "unrecognised line")
        .when((kind == "T") & ~part(SPAN_LINE, 2).isin(*COMPONENT_TYPES), "unexpected label")
        .when((kind == "R") & ~part(EDGE_LINE, 2).isin(*RELATION_TYPES), "unexpected label")
        .when((kind == "A") & (part(ATTRIBUTE_LINE, 2) != "Stance"), "unexpected attribute")
        .when((kind == "A") & ~part(ATTRIBUTE_LINE, 4).isin(*STANCES), "unexpected stance")
    )
    return rows.select("doc_id", "pos", "line", kind.alias("line_kind"), error.alias("error"))


def parse_annotations(docs: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(components, relations, errors) of documents ``(doc_id, text, ann)``.

    Offsets are the truth; ``check`` compares the text they give with the recorded
    one. Discontinuous spans are dropped with every relation that touches them.
    In strict mode a bad line or a drifted offset fails the job.
    """
    lines = annotation_lines(docs)
    if strict:
        stop = F.raise_error(F.concat("doc_id", F.lit(": "), "error", F.lit(": "), "line"))
        # on the kind, which every selection below has to read
        kind = F.when(F.col("error").isNotNull(), stop.cast("string")).otherwise(F.col("line_kind"))
        lines = lines.withColumn("line_kind", kind)
    good = lines.filter(F.col("error").isNull()) if not strict else lines
    line = F.col("line")

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(line, pattern, i)

    spans = good.filter("line_kind = 'T'").select(
        "doc_id", "pos", part(SPAN_LINE, 1).alias("comp_id"), part(SPAN_LINE, 2).alias("ctype"),
        F.split(F.trim(part(SPAN_LINE, 3)), " +").alias("at"),
        F.contains(part(SPAN_LINE, 3), F.lit(";")).alias("broken"),
        part(SPAN_LINE, 4).alias("declared"),
    )
    # an id that is recorded again means the last record
    last = W.partitionBy("doc_id", "comp_id").orderBy(F.desc("pos"))
    spans = spans.withColumn("nth", F.row_number().over(last)).filter("nth = 1").drop("nth")
    stances = (
        good.filter("line_kind = 'A'")
        .groupBy("doc_id", part(ATTRIBUTE_LINE, 3).alias("comp_id"))
        .agg(F.max_by(part(ATTRIBUTE_LINE, 4), "pos").alias("stance"))
    )
    whole = spans.filter(~F.col("broken")).select(
        "doc_id", "pos", "comp_id", "ctype", "declared",
        F.col("at")[0].cast("bigint").alias("start_off"), F.col("at")[1].cast("bigint").alias("end_off"),
    )
    derived = piece_of(F.col("text"), F.col("start_off"), F.col("end_off"))
    components = (
        whole.join(docs.select("doc_id", blocks(F.col("text")).alias("text")).hint("merge"), "doc_id")
        .withColumn("text", derived)
        .withColumn("check", offset_check(F.col("text"), F.col("declared")))
        .join(stances, ["doc_id", "comp_id"], "left")
    )
    by_place = W.partitionBy("doc_id").orderBy("start_off", "end_off", "comp_id")
    components = components.withColumn("idx", F.row_number().over(by_place).cast("bigint") - 1)
    if strict:
        drift = F.raise_error(F.concat("doc_id", F.lit("/"), "comp_id", F.lit(": offsets and recorded text differ")))
        components = components.withColumn(
            "check", F.when(F.col("check") == "drift", drift.cast("string")).otherwise(F.col("check"))
        )
    edges = good.filter("line_kind = 'R'").select(
        "doc_id", "pos", part(EDGE_LINE, 1).alias("rel_id"), part(EDGE_LINE, 2).alias("rtype"),
        part(EDGE_LINE, 3).alias("src"), part(EDGE_LINE, 4).alias("tgt"),
    )
    gone = spans.filter("broken").select("doc_id", "comp_id").distinct()
    for end in ("src", "tgt"):
        edges = edges.join(gone.withColumnRenamed("comp_id", end), ["doc_id", end], "left_anti")
    errors = lines.filter(F.col("error").isNotNull()).select("doc_id", "pos", "error")
    return components, edges, errors


def read_split_csv(files: DataFrame) -> DataFrame:
    """(doc_id, split) of whole ``ID;SET`` files ``(path, value)``: header, quotes, byte-order mark.

    A file that does not begin with the header or names another split ends the job. A
    quoted cell may hold the delimiter, and quotes that are doubled; lines of fewer than two cells are skipped.
    """
    clean = F.regexp_replace("value", "^\ufeff", "")
    line = F.filter(F.split(clean, r"\r\n|\n|\r"), lambda x: F.trim(x) != "")
    cells = F.from_csv("line", "id string, set string", {"sep": ";", "escape": '"', "mode": "PERMISSIVE"})
    rows = files.select("path", F.posexplode(line).alias("k", "line")).withColumn("c", cells)
    name = F.upper(F.trim("c.set"))
    head = (F.upper(F.trim("c.id")) == "ID") & (name == "SET")
    no_header = F.raise_error(F.concat(F.lit("no ID;SET header in "), "path")).cast("string")
    unknown = F.raise_error(F.concat(F.lit("no such split: "), name)).cast("string")
    split = F.when(name == "TRAIN", "train").when(name == "TEST", "test").otherwise(unknown)
    kept = rows.filter(F.when(F.col("k") == 0, F.when(~F.coalesce(head, F.lit(False)), no_header).isNotNull()).otherwise(F.col("c.set").isNotNull()))
    return kept.select(F.trim("c.id").alias("doc_id"), split.alias("split"))


def with_split(docs: DataFrame, splits: DataFrame) -> DataFrame:
    """Documents the list does not name are training documents."""
    return docs.join(splits, "doc_id", "left").withColumn("split", F.coalesce("split", F.lit("train")))
