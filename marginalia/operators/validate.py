"""Integrity of documents, spans, ids and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import blocks, piece_of, strip
from marginalia.schemas import MAX_DOCUMENT_CHARS, SPLITS
from marginalia.session import tasks


def violations(docs: DataFrame, components: DataFrame, relations: DataFrame) -> DataFrame:
    """Every broken rule as (doc_id, item, rule).

    ``docs (doc_id, text)``, ``components (doc_id, comp_id, start_off, end_off,
    text)``, ``relations (doc_id, rel_id, src, tgt)``.
    """
    start, end = F.col("start_off"), F.col("end_off")
    # dealt before they are counted and cut up, and met by sorting: once per text, not per component
    texts = docs.select("doc_id", "text").repartition(tasks(docs.sparkSession), "doc_id")
    texts = texts.select("doc_id", F.length("text").alias("doc_chars"), blocks(F.col("text")).alias("doc_text"))
    placed = components.join(texts.hint("merge"), "doc_id")
    fits = (start >= 0) & (end > start) & (end <= F.col("doc_chars"))
    rules = F.array_compact(
        F.array(
            F.when((start < 0) | (end < 0), "negative offset"),
            F.when(end <= start, "empty or inverted span"),
            F.when(end > F.col("doc_chars"), "span beyond text"),
            F.when(fits & (piece_of(F.col("doc_text"), start, end) != F.col("text")), "text mismatch"),
        )
    )
    spans = placed.select("doc_id", F.col("comp_id").alias("item"), F.explode(rules).alias("rule"))

    def repeated(df: DataFrame, item: str, rule: str) -> DataFrame:
        seen = df.groupBy("doc_id", F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("n"))
        return seen.filter("n > 1").select("doc_id", "item", F.lit(rule).alias("rule"))

    loops = relations.filter(F.col("src") == F.col("tgt")).select(
        "doc_id", F.col("rel_id").alias("item"), F.lit("self loop").alias("rule")
    )
    known = components.select("doc_id", F.col("comp_id").alias("end")).distinct()
    ends = relations.select(
        "doc_id", F.col("rel_id").alias("item"), F.explode(F.array("src", "tgt")).alias("end")
    )
    loose = ends.join(known, ["doc_id", "end"], "left_anti").select(
        "doc_id", "item", F.lit("endpoint is not a component").alias("rule")
    )
    return (
        spans.unionByName(repeated(components, "comp_id", "duplicate component id"))
        .unionByName(repeated(relations, "rel_id", "duplicate relation id"))
        .unionByName(loops)
        .unionByName(loose)
        .distinct()
    )


def require_valid(docs: DataFrame, components: DataFrame, relations: DataFrame) -> None:
    """Strict mode: fail on the first violations found."""
    bad = violations(docs, components, relations).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.doc_id}/{r.item}: {r.rule}" for r in bad))


def offset_check(derived: Column, declared: Column) -> Column:
    """Offsets are the truth: 'fixup' for outer space only, 'drift' for anything else."""
    return (
        F.when(derived == declared, "same")
        .when(strip(derived) == strip(declared), "fixup")
        .otherwise("drift")
    )


def triage(text: Column, route: Column) -> Column:
    """The status a request gets before any work is done."""
    # fixed values: known routes, and the one that is configured
    return (
        F.when((F.length(text) < 1) | (F.length(text) > MAX_DOCUMENT_CHARS), 422)
        .when(~route.isin("claude", "local", "cascade"), 422)
        .when(strip(text) == "", 400)
        .when(route != "claude", 503)
        .otherwise(200)
    )


def id_problems(ids: DataFrame) -> DataFrame:
    """Split lists must hold ids only: (split, doc_id, rule) for what does not look like one."""
    doc = F.col("doc_id").cast("string")
    rules = F.array_compact(
        F.array(
            F.when(~F.col("split").isin(*SPLITS), "unknown split"),
            F.when(F.contains(doc, F.lit(" ")), "blank in id"),
            F.when(F.length(doc) >= 64, "too long for an id"),
        )
    )
    return ids.select("split", "doc_id", F.explode(rules).alias("rule"))


def shared_ids(ids: DataFrame, group: str) -> DataFrame:
    """Ids that appear in more than one group (corpus or split)."""
    seen = ids.groupBy("doc_id").agg(F.countDistinct(group).alias("groups"))
    return seen.filter("groups > 1")
