"""Confidence-routed blending of two systems and the choice of an operating point.

Both systems are scored once. Blending adds, for every escalated document, the
difference between the second and the first system's counts, so a whole sweep is
one grouped sum over documents and a running sum over at most 22 thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.stats import f1, values_at_ranks
from marginalia.operators.resample import intervals

STEPS = 21
EDGE = 1e-9
KINDS = ("components", "relations")
COUNTS = ("tp", "fp", "fn")


def thresholds(conf: DataFrame, steps: int = STEPS, column: str = "mean_logprob") -> DataFrame:
    """Quantiles of the observed confidences and a point beyond each end, ascending."""

    def at(i: int):
        return lambda n: F.least(n - 1, F.floor(F.lit(i / steps) * n.cast("double")))

    ranks = {f"q{i}": at(i) for i in range(1, steps)}
    ranks["first"] = lambda n: F.lit(0)
    ranks["last"] = lambda n: n - 1
    row = values_at_ranks(conf, [], column, ranks)
    points = F.array(
        F.col("first") - EDGE, *[F.col(f"q{i}") for i in range(1, steps)], F.col("last") + EDGE
    )
    none = F.array(F.lit(float("inf")))
    kept = F.when(F.col("first").isNull(), none).otherwise(F.array_sort(F.array_distinct(points)))
    return row.select(F.posexplode(kept).alias("step", "threshold"))


def legs(scores: DataFrame, conf: DataFrame, criterion: str, first=0, second=1) -> DataFrame:
    """One row per document: confidence and both systems' counts for both kinds."""
    mine = scores.filter((F.col("criterion") == criterion) & (F.col("label") == "*"))
    cols = [
        F.sum(F.when((F.col("system_id") == system) & (F.col("kind") == kind), F.col(c))).alias(
            f"{leg}_{kind}_{c}"
        )
        for leg, system in (("a", first), ("b", second))
        for kind in KINDS
        for c in COUNTS
    ]
    return mine.groupBy("doc_id").agg(*cols).join(
        conf.select("doc_id", F.col("mean_logprob").alias("conf")), "doc_id", "left"
    )


def escalates(conf: Column, threshold: Column) -> Column:
    """A document without a confidence is never trusted."""
    return conf.isNull() | (conf < threshold)


def blend(docs: DataFrame, threshold: Column, kind: str) -> list[Column]:
    """The counts the cascade gets on each document at a threshold."""
    up = escalates(F.col("conf"), threshold)
    return [
        F.when(up, F.col(f"b_{kind}_{c}")).otherwise(F.col(f"a_{kind}_{c}")).alias(c) for c in COUNTS
    ]


def curve(docs: DataFrame, points: DataFrame, local_cost: Column, api_cost: Column) -> DataFrame:
    """Escalation, quality and price at every threshold."""
    grid = points.agg(F.array_sort(F.collect_list("threshold"))).scalar()
    vec = [(kind, c) for kind in KINDS for c in COUNTS]
    # a document is escalated from the first threshold above its confidence on
    from_step = F.when(F.col("conf").isNull(), 0).otherwise(
        F.size(F.filter(F.col("grid"), lambda t: t <= F.col("conf")))
    )
    buckets = (
        docs.withColumn("grid", grid)
        .groupBy(from_step.alias("step"))
        .agg(
            F.count(F.lit(1)).alias("docs"),
            *[F.sum(f"a_{k}_{c}").alias(f"a_{k}_{c}") for k, c in vec],
            *[F.sum(F.col(f"b_{k}_{c}") - F.col(f"a_{k}_{c}")).alias(f"d_{k}_{c}") for k, c in vec],
        )
    )
    steps = points.select("step", "threshold").join(buckets, "step", "full_outer")
    upto = W.orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    every = W.orderBy("step").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0).cast("bigint")
    summed = steps.select(
        "step",
        "threshold",
        F.coalesce(F.sum("docs").over(upto), zero).alias("escalated"),
        F.sum("docs").over(every).alias("documents"),
        *[
            (
                F.sum(f"a_{k}_{c}").over(every) + F.coalesce(F.sum(f"d_{k}_{c}").over(upto), zero)
            ).alias(f"{k}_{c}")
            for k, c in vec
        ],
    ).filter(F.col("threshold").isNotNull())
    n, up = F.col("documents"), F.col("escalated")
    return summed.select(
        "step",
        "threshold",
        "escalated",
        "documents",
        (up.cast("double") / n.cast("double")).alias("escalation_rate"),
        *[f1(*[F.col(f"{k}_{c}") for c in COUNTS]).alias(f"{k[:-1]}_f1") for k in KINDS],
        ((n * local_cost + up * api_cost) / n * 1000).alias("usd_per_1k"),
    )


def best_point(sweep: DataFrame) -> DataFrame:
    """Highest component F1; the lowest threshold among equals."""
    return sweep.orderBy(F.desc("component_f1"), "threshold").limit(1)


def cheapest_sound_point(docs: DataFrame, sweep: DataFrame, **options) -> DataFrame:
    """The cheapest threshold not significantly different from the best one."""
    best = best_point(sweep).select("threshold").scalar()
    grid = sweep.agg(F.collect_list("threshold")).scalar()
    at = docs.withColumn("best", best).withColumn("threshold", F.explode(grid))
    a = blend(at, F.col("threshold"), "components")
    b = blend(at, F.col("best"), "components")
    names = [f"{side}_{c}" for side in ("a", "b") for c in COUNTS]
    counts = at.select("threshold", "doc_id", *[c.alias(n) for c, n in zip([*a, *b], names)])
    delta = intervals(counts, ["threshold"], paired=True, **options)
    return (
        sweep.join(delta.filter(~F.col("excludes_zero")).select("threshold"), "threshold")
        .orderBy("usd_per_1k", "threshold")
        .limit(1)
    )


def report(docs: DataFrame, threshold: Column, **options) -> DataFrame:
    """The cascade at a fixed threshold against both of its legs, per kind.

    Rows: the cascade's own F1, and its paired difference to each leg.
    """
    at = docs.withColumn("threshold", threshold)
    one, pairs = [], []
    for kind in KINDS:
        mine = blend(at, F.col("threshold"), kind)
        key = F.lit(kind).alias("kind")
        one.append(at.select(key, "doc_id", *mine))
        for leg, name in (("b", "second_only"), ("a", "first_only")):
            other = [F.col(f"{leg}_{kind}_{c}").alias(f"b_{c}") for c in COUNTS]
            blended = [c.alias(f"a_{n}") for c, n in zip(mine, COUNTS)]
            pairs.append(at.select(key, F.lit(name).alias("against"), "doc_id", *blended, *other))
    own = intervals(one[0].unionByName(one[1]), ["kind"], **options)
    deltas = pairs[0]
    for p in pairs[1:]:
        deltas = deltas.unionByName(p)
    versus = intervals(deltas, ["kind", "against"], paired=True, **options)
    return own.withColumn("against", F.lit("none")).unionByName(versus)


def operating_points(docs: DataFrame, threshold: Column, local_cost: Column, api_cost: Column) -> DataFrame:
    """Escalation, quality and price of the cascade and of both its legs alone.

    Rows ``first_only`` (only documents without a confidence are escalated), ``cascade`` and
    ``second_only`` (all are). No threshold means that everything is escalated.
    """
    ends = F.lit(float("inf"))
    chosen = F.coalesce(threshold, ends)
    names = ("first_only", "cascade", "second_only")
    points = docs.sparkSession.range(1).select(F.posexplode(F.array(-ends, chosen, ends)).alias("step", "threshold"))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("step") + 1)
    return curve(docs, points, local_cost, api_cost).filter("threshold is not null").select(
        name.alias("point"),
        F.when(name == "cascade", F.col("threshold")).alias("threshold"),
        "escalated", "documents", "escalation_rate", "component_f1", "relation_f1", "usd_per_1k",
    )


def criterion_for(gold: DataFrame, typed: str, untyped: str) -> Column:
    """The label results are reported under: ``untyped`` where no gold component has a type."""
    return gold.agg(
        F.when(F.coalesce(F.bool_or(F.col("ctype").isNotNull()), F.lit(False)), typed).otherwise(untyped).alias("c")
    ).scalar()
