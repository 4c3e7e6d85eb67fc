"""Raw model answers: health, comparison, and what failed to parse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.jsontext import parse_object


def unparseable(generations: DataFrame, text: str = "answer") -> DataFrame:
    """Ids of documents whose answer is not a JSON object."""
    return generations.filter(parse_object(F.col(text)).isNull()).select("doc_id").distinct()


def health(generations: DataFrame, keys: Sequence[str], text: str = "answer") -> DataFrame:
    """Invalid and truncated answers and mean length per group."""
    n = F.count(F.lit(1))
    invalid = F.count_if(parse_object(F.col(text)).isNull())
    truncated = F.count_if(F.coalesce(F.col("finish_reason") == "length", F.lit(False)))
    tokens = F.sum(F.coalesce("output_tokens", F.lit(0)))
    return generations.groupBy(*keys).agg(
        n.alias("documents"),
        invalid.alias("invalid_json"),
        F.bround(invalid / n, 4).alias("invalid_rate"),
        truncated.alias("truncated"),
        F.bround(truncated / n, 4).alias("truncation_rate"),
        F.bround(tokens / n, 1).alias("mean_output_tokens"),
    )


def flag_warnings(runs: DataFrame) -> DataFrame:
    """Runs whose own ``constrained`` flag contradicts the role they were given."""
    expected = F.col("role") == "constrained"
    return runs.filter(~F.coalesce("constrained", F.lit(False)).eqNullSafe(expected))


def same_output(shapes: DataFrame, first: str, second: str) -> DataFrame:
    """Documents on which two variants gave the same output, and what that says.

    ``shapes`` holds (which, doc_id, sha256_16, parses).
    """

    def side(name: str, alias: str) -> DataFrame:
        mine = shapes.filter(F.col("which") == name)
        return mine.groupBy("doc_id").agg(
            F.max("sha256_16").alias(f"{alias}_hash"),
            F.max(F.col("parses").cast("int")).alias(f"{alias}_parses"),
        )

    both = side(first, "a").join(side(second, "b"), "doc_id", "full_outer")
    same = F.count_if(F.coalesce(F.col("a_hash") == F.col("b_hash"), F.lit(False)))
    a, b = (F.coalesce(F.sum(f"{s}_parses"), F.lit(0)) for s in ("a", "b"))
    out = both.agg(
        F.count(F.lit(1)).alias("documents"), same.alias("identical"),
        a.alias("first_parses"), b.alias("second_parses"),
    )
    verdict = (
        F.when(F.col("identical") == F.col("documents"), "no effect")
        .when(F.col("second_parses") <= F.col("first_parses"), "format not learned")
        .otherwise("ok")
    )
    return out.withColumn("verdict", verdict)


def token_confidence(generations: DataFrame, logprobs: str = "logprobs") -> DataFrame:
    """Mean and minimum over tokens of the best alternative's log probability."""
    best = F.filter(F.transform(F.col(logprobs), lambda t: F.array_max(t)), lambda x: x.isNotNull())
    n = F.size("__best")
    total = F.aggregate("__best", F.lit(0.0), lambda a, x: a + x)
    return (
        generations.withColumn("__best", best)
        .withColumn("mean_logprob", F.when(n > 0, total / n))
        .withColumn("min_logprob", F.array_min("__best"))
        .drop("__best")
    )
