"""Running totals and places in a total order, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.session import cut


def running(df: DataFrame, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows that stand before a row in ``order``.

    Rows are dealt to tasks by ranges of ``order``, so that equal leading columns split as soon
    as a later one differs. Totals of the ranges are added up first, one row each; then every
    range runs on its own. ``order`` should be unique: rows equal in it have no defined sequence.
    """
    ranged = df.withColumn("__value", value).repartitionByRange(*order)
    # written once: a second evaluation could draw other borders
    ranged = cut(ranged.withColumn("__range", F.spark_partition_id()))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("__range").agg(F.sum("__value").alias("__total"))
    starts = totals.select("__range", F.sum("__total").over(before).alias("__start"))
    inside = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast(ranged.schema["__value"].dataType)
    found = F.coalesce("__start", zero) + F.coalesce(F.sum("__value").over(inside), zero)
    return ranged.join(starts, "__range").withColumn(name, found).drop("__value", "__range", "__start")


def positions(df: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """``df`` with each row's 0-based place in ``order``."""
    return running(df, order, F.lit(1).cast("bigint"), name)
