"""Normalising the older claim/relationship answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.operators.align import align

# ---- fixed values -------------------------------------------------------------------
CLAIM_TYPES = ("premise", "conclusion", "objection", "assumption", "weakness", "hidden_assumption")
LINK_TYPES = ("supports", "opposes", "refines", "depends_on")
REASONING_TYPES = ("deductive", "inductive", "abductive", "analogical")
FRAMINGS = ("neutral", "loaded", "one_sided", "balanced")
PERSPECTIVES = 3
# ---------------------------------------------------------------------------------------


def _one_of(col: str, allowed: tuple[str, ...], fallback: str) -> Column:
    return F.when(F.col(col).isin(*allowed), F.col(col)).otherwise(fallback)


def _unit(rows: DataFrame, col: str) -> Column:
    """Clamped to [0, 1]; what is no number is 0.5, a text that looks like one too."""
    kind, value = rows.schema[col].dataType, F.col(col)
    if isinstance(kind, T.VariantType):
        named = F.schema_of_variant(value)
        number = F.when(named.isin("STRING", "VOID"), F.lit(None)).otherwise(F.try_variant_get(value, "$", "double"))
        value = F.when(named == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).otherwise(number)
    elif isinstance(kind, T.StringType):
        value = F.lit(None)
    value = value.cast("double")
    return F.when(value.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def claims(rows: DataFrame, length: str) -> DataFrame:
    """Claims not located in the text keep their stated span, clamped to it."""
    n, zero = F.col(length), F.lit(0).cast("bigint")
    start = F.greatest(zero, F.least(F.coalesce("source_start", zero), n - 1))
    end = F.greatest(start + 1, F.least(F.coalesce("source_end", n), n))
    return rows.withColumns(
        {
            "type": _one_of("type", CLAIM_TYPES, "premise"),
            "confidence": _unit(rows, "confidence"),
            "source_start": start,
            "source_end": end,
        }
    )


def located_claims(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Claims placed where their text stands in the document, else where they say, clamped to it.

    ``rows``: ``doc_id, idx, claim`` and the columns of :func:`claims`; ``docs``: ``doc_id, text``.
    """
    size = docs.select("doc_id", F.length("text").cast("bigint").alias("__length"))
    stated = claims(rows.join(size, "doc_id"), "__length").drop("__length")
    needles = rows.select("doc_id", "idx", F.coalesce("claim", F.lit("")).alias("needle"))
    spots = align(needles, docs, refine=False).select("doc_id", "idx", "start_off", "end_off")
    return stated.join(spots, ["doc_id", "idx"], "left").withColumns(
        {
            "source_start": F.coalesce("start_off", "source_start"),
            "source_end": F.when(F.col("start_off").isNull(), F.col("source_end")).otherwise(F.col("end_off")),
        }
    ).drop("start_off", "end_off")


def relationships(rows: DataFrame, claim_ids: DataFrame) -> DataFrame:
    """Links between known claims only. ``claim_ids (doc_id, claim_id)``."""
    out = rows
    for end in ("source", "target"):
        known = claim_ids.select("doc_id", F.col("claim_id").alias(end)).distinct()
        out = out.join(known, ["doc_id", end], "left_semi")
    return out.withColumns(
        {
            "type": _one_of("type", LINK_TYPES, "supports"),
            "strength": _unit(rows, "strength"),
            "reasoning_type": _one_of("reasoning_type", REASONING_TYPES, "deductive"),
        }
    )


def bias(rows: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return rows.withColumns(
        {
            "framing": _one_of("framing", FRAMINGS, "neutral"),
            "dominant_perspective": F.coalesce("dominant_perspective", F.lit("")),
            "underrepresented_perspectives": F.coalesce(
                F.slice("underrepresented_perspectives", 1, PERSPECTIVES), none
            ),
        }
    )
