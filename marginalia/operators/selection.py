"""Variance across runs and the choice of a checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seed_variance(reports: DataFrame, model: str, value: str, selected: str) -> DataFrame:
    """Spread of a score over models per (criterion, kind); one run alone has no spread."""
    x, n = F.col(value), F.count(F.lit(1))
    if "status" in reports.columns:
        reports = reports.filter(F.col("status") != "not_applicable")
    grouped = reports.groupBy("criterion", "kind").agg(
        n.alias("n_seeds"),
        F.bround(F.avg(x), 6).alias("mean"),
        F.bround(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 6).alias("std"),
        F.bround(F.min(x), 6).alias("min"),
        F.bround(F.max(x), 6).alias("max"),
        F.bround(F.max(F.when(F.col(model) == selected, x)), 6).alias("selected"),
        # one entry per model: as many as there are runs
        F.map_from_entries(F.collect_list(F.struct(F.col(model), x))).alias("by_model"),
    )
    lone = F.raise_error(F.lit("need at least two runs to report variance"))
    checked = F.when(F.col("n_seeds") < 2, lone).otherwise(F.col("n_seeds")).cast("bigint")
    return grouped.withColumn("n_seeds", checked)


def path_field(path: Column, key: str) -> Column:
    """What follows ``key`` in the path part that starts with it."""
    found = F.regexp_extract(path, f"(?:^|/){key}([^/]*)", 1)
    return F.when(path.rlike(f"(?:^|/){key}"), found)


def rank_checkpoints(reports: DataFrame, model: str) -> DataFrame:
    """Checkpoints by the mean of component and relation F1, best first."""

    def of(kind: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, F.col("f1")))

    score = F.bround((of("components") + of("relations")) / 2, 6)
    ranked = reports.groupBy(model).agg(score.alias("selection_score"))
    # one row per checkpoint: a handful, so a global order is fine
    place = F.row_number().over(W.orderBy(F.desc("selection_score"), model))
    return ranked.select(
        model,
        path_field(F.col(model), "seed").alias("seed"),
        path_field(F.col(model), "epoch").alias("epoch"),
        "selection_score",
        place.alias("place"),
    )


def score_by_epoch(ranked: DataFrame) -> DataFrame:
    x, n = F.col("selection_score"), F.count(F.lit(1))
    # scores have six places: their mean is taken in whole millionths, so that a
    # tie is a tie whatever order the scores are added in
    millionths = F.sum(F.bround(x * 1_000_000, 0).cast("bigint"))
    return ranked.groupBy("epoch").agg(
        n.alias("seeds"),
        (F.bround(millionths / n, 0) / 1_000_000).alias("mean"),
        F.bround(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 6).alias("std"),
    )


def attach_epoch_metrics(checkpoints: DataFrame, log: DataFrame, metrics: list[str]) -> DataFrame:
    """Metrics of the last log entry whose rounded epoch is the checkpoint's.

    Each metric comes from entries that carry it: evaluation and training entries
    are logged apart.
    """
    last = [
        F.max_by(F.col(m), F.when(F.col(m).isNotNull(), F.col("step"))).alias(m) for m in metrics
    ]
    by_epoch = log.groupBy(F.bround("epoch", 0).cast("bigint").alias("epoch")).agg(*last)
    return checkpoints.join(by_epoch, "epoch", "left")
