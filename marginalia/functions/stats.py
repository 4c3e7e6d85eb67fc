"""Scores and exact order statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top.cast("double") / bottom.cast("double")).otherwise(F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """Micro-F1 from counts; 0 where nothing was there to find or found."""
    return ratio_or_zero(2 * tp, 2 * tp + fp + fn)


def prf_columns(tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [
        (tp + fn).alias("support"),
        ratio_or_zero(tp, tp + fp).alias("precision"),
        ratio_or_zero(tp, tp + fn).alias("recall"),
        f1(tp, fp, fn).alias("f1"),
    ]


# Steps of the approximate quantile grid, and the sketch's accuracy: its rank error is
# a tenth of a step.
STEPS = 1000
ACCURACY = 10_000


def values_at_ranks(
    df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]]
) -> DataFrame:
    """The values standing at given 0-based sorted positions of every group.

    ``ranks`` maps an output name to a function of the group size. Sorting a
    whole group in one task is avoided: an approximate quantile grid, whose error is
    bounded whatever the distribution, brackets each rank between two values. Rows
    below the bracket are only counted, and the few distinct values inside are ranked.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    grid = F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])
    sizes = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", grid, ACCURACY).alias("__grid")
    )
    named = F.array(
        *[F.struct(F.lit(name).alias("name"), fn(F.col("__n")).cast("bigint").alias("rank")) for name, fn in ranks.items()]
    )
    step = F.floor(F.col("__w.rank") / F.col("__n") * STEPS).cast("int")
    wanted = sizes.filter("__n > 0").select(*keys, "__n", "__grid", F.explode(named).alias("__w")).select(
        *keys,
        F.col("__w.name").alias("__name"),
        F.col("__w.rank").alias("__rank"),
        F.get("__grid", F.greatest(step - 1, F.lit(0))).alias("__lo"),
        F.get("__grid", F.least(step + 2, F.lit(STEPS))).alias("__hi"),
    )
    met = _join(rows, wanted, keys).filter(F.col("__v") <= F.col("__hi"))
    inside = F.when(F.col("__v") >= F.col("__lo"), F.col("__v"))
    counts = met.groupBy(*keys, "__name", "__rank", inside.alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    # rows below the bracket have no value and come first
    run = W.partitionBy(*keys, "__name").orderBy(F.asc_nulls_first("__v")).rowsBetween(W.unboundedPreceding, 0)
    picked = (
        counts.withColumn("__end", F.sum("__c").over(run))
        .filter((F.col("__end") > F.col("__rank")) & F.col("__v").isNotNull())
        .groupBy(*keys, "__name")
        .agg(F.min("__v").alias("__v"))
    )
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in ranks]
    )


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on group keys; a table without keys is one group of one row."""
    if keys:
        return left.join(right, keys)
    one = F.lit(1).alias("__one")
    return left.select("*", one).join(F.broadcast(right.select("*", one)), "__one").drop("__one")


def lower_rank(q: float) -> Callable[[Column], Column]:
    """Nearest rank from below: position ``floor(q * (n - 1))``."""
    return lambda n: F.floor(F.lit(float(q)) * (n - 1).cast("double"))
