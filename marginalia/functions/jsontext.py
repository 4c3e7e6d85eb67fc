"""JSON text: parse or nothing, salvage, shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import lines, strip


def is_object(variant: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(variant), F.lit("OBJECT")), F.lit(False))


def is_array(variant: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(variant), F.lit("ARRAY")), F.lit(False))


def parse_object(raw: Column) -> Column:
    """The parsed value where the text is one JSON object, else null. Nothing is repaired."""
    value = F.try_parse_json(raw)
    return F.when(is_object(value), value)


def salvage_candidates(raw: Column) -> list[tuple[str, Column]]:
    """Readings of a damaged answer, most trusted first."""
    # fixed patterns: a fenced block, the outermost braces, an opening fence
    fenced = F.regexp_extract(raw, "(?s)```(?:json)?\\s*\\n?(.*?)\\n?```", 1)
    braces = F.regexp_extract(raw, "(?s)\\{.*\\}", 0)
    bare = F.regexp_replace(strip(raw), "^```(?:json)?\\s*\\n?", "")
    upto_last = F.regexp_extract(bare, "(?s)^.*\\}", 0)
    has_last = F.contains(bare, F.lit("}"))
    out = [
        ("whole", raw),
        ("fenced", F.when(raw.rlike("(?s)```(?:json)?\\s*\\n?(.*?)\\n?```"), fenced)),
        ("braces", F.when(raw.rlike("(?s)\\{.*\\}"), braces)),
    ]
    # fixed values: the closers tried on a truncated answer
    for closer in ("]}", "}]}", "]}]"):
        out.append((f"closed {closer}", F.when(has_last, F.concat(upto_last, F.lit(closer)))))
    return out


def salvage(raw: Column) -> Column:
    """struct(stage, body) of the first reading that parses; null where none does."""
    options = F.array(
        *[
            F.when(
                F.try_parse_json(text).isNotNull(),
                F.struct(F.lit(stage).alias("stage"), text.alias("body")),
            )
            for stage, text in salvage_candidates(raw)
        ]
    )
    return F.get(F.filter(options, lambda o: o.isNotNull()), F.lit(0))


def shape(raw: Column) -> Column:
    """What a text looks like, without a word of it."""
    bare = strip(raw)
    rows = lines(bare)
    value = F.try_parse_json(bare)
    whole = F.when(is_object(value), bare)
    keys = F.array_join(F.array_sort(F.json_object_keys(whole)), ",")

    def size(field: str) -> Column:
        part = F.try_variant_get(F.when(is_object(value), value), f"$.{field}", "variant")
        return F.when(is_array(part), F.size(F.try_variant_get(part, "$", "array<variant>")))

    left = F.transform(rows, lambda r: F.regexp_replace(r, "^\\s+", ""))
    return F.struct(
        F.length(bare).cast("bigint").alias("chars"),
        F.size(rows).cast("bigint").alias("lines"),
        F.substring(F.sha2(bare, 256), 1, 16).alias("sha256_16"),
        F.startswith(bare, F.lit("{")).alias("starts_with_brace"),
        F.size(F.filter(left, lambda r: F.startswith(r, F.lit("#")))).cast("bigint").alias("heading_lines"),
        F.size(F.filter(left, lambda r: F.substring(r, 1, 2).isin("- ", "* "))).cast("bigint").alias("bullet_lines"),
        value.isNotNull().alias("parses"),
        keys.alias("top_level_keys"),
        size("components").cast("bigint").alias("n_components"),
        size("relations").cast("bigint").alias("n_relations"),
    )
