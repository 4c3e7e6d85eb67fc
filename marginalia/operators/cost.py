"""Spend: pricing, scoped means, totals, admission under a cap, cache counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.stats import lower_rank, values_at_ranks
from marginalia.operators.ranking import running
from marginalia.schemas import (
    BATCH_MULTIPLIER,
    CACHE_READ_MULTIPLIER,
    CACHE_WRITE_MULTIPLIER,
    GPU_USD_PER_HOUR,
    PRICING,
)


def _rate(model: Column, which: int) -> Column:
    rate = F.lit(0.0)
    for row in PRICING:
        rate = F.when(model == row[0], F.lit(row[which])).otherwise(rate)
    return rate


def price(
    model: Column,
    tokens_in: Column,
    tokens_out: Column,
    cache_read: Column | None = None,
    cache_write: Column | None = None,
    batch: Column | None = None,
) -> Column:
    """Dollars for one call; a model without a price costs nothing."""
    rate_in, rate_out = _rate(model, 1), _rate(model, 2)
    total = tokens_in * rate_in + tokens_out * rate_out
    if cache_read is not None:
        total = total + cache_read * rate_in * F.lit(CACHE_READ_MULTIPLIER)
    if cache_write is not None:
        total = total + cache_write * rate_in * F.lit(CACHE_WRITE_MULTIPLIER)
    dollars = total / F.lit(1_000_000.0)
    return dollars if batch is None else F.when(batch, dollars * BATCH_MULTIPLIER).otherwise(dollars)


def exact_sum(dollars: Column, scale: int = 12) -> Column:
    """A sum that does not depend on the order of its rows."""
    return F.sum(dollars.cast(f"decimal(38,{scale})")).cast("double")


def scoped_cost(ledger: DataFrame, scopes: DataFrame) -> DataFrame:
    """Mean dollars per call for (corpus, split, model) over that scope's documents only.

    Cache hits are left out. A document id names one scope's document, so this is
    one join on the id; only ids and their scope are joined, never texts.
    """
    live = ledger.filter(~F.coalesce("cached", F.lit(False)))
    joined = live.select("model", "doc_id", "dollars").join(
        scopes.select("corpus", "split", "doc_id").distinct(), "doc_id"
    )
    total, calls = exact_sum(F.col("dollars")), F.count(F.lit(1))
    return joined.groupBy("corpus", "split", "model").agg(
        calls.alias("calls"), total.alias("total"), (total / calls).alias("mean")
    )


def cost_by_scope(ledger: DataFrame, scopes: DataFrame, local_usd_per_doc: float) -> DataFrame:
    """Every scope with every model, including the ones never called."""
    models = ledger.filter(F.col("model").isNotNull()).agg(F.array_sort(F.collect_set("model")))
    grid = (
        scopes.groupBy("corpus", "split")
        .agg(F.countDistinct("doc_id").alias("documents"))
        .withColumn("model", F.explode(models.scalar()))
    )
    mean = F.bround("mean", 8)
    ratio = F.bround(mean / F.lit(local_usd_per_doc), 1) if local_usd_per_doc else F.lit(None)
    return grid.join(scoped_cost(ledger, scopes), ["corpus", "split", "model"], "left").select(
        "corpus",
        "split",
        "documents",
        "model",
        F.coalesce("calls", F.lit(0)).cast("bigint").alias("calls"),
        F.bround("total", 6).alias("usd_total"),
        mean.alias("usd_per_doc"),
        F.bround(F.col("mean") * 1000, 4).alias("usd_per_1k"),
        ratio.cast("double").alias("vs_local"),
    )


def unscoped(ledger: DataFrame, scopes: DataFrame) -> DataFrame:
    """Ledger rows that belong to no scope; a missing document id counts as ''."""
    return ledger.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).join(
        scopes.select(F.col("doc_id").cast("string").alias("doc_id")).distinct(), "doc_id", "left_anti"
    )


def totals(ledger: DataFrame) -> DataFrame:
    return (
        ledger.filter(F.col("model").isNotNull())
        .groupBy("model")
        .agg(F.count(F.lit(1)).alias("calls"), exact_sum(F.col("dollars")).alias("usd_total"))
        .withColumn("usd_total", F.bround("usd_total", 6))
    )


def spend_summary(ledger: DataFrame, cap: float) -> DataFrame:
    spent = F.coalesce(exact_sum(F.col("dollars")), F.lit(0.0))
    return ledger.agg(spent.alias("s")).select(
        F.bround("s", 6).alias("spent_usd"),
        F.lit(float(cap)).alias("cap_usd"),
        F.bround(F.greatest(F.lit(0.0), F.lit(float(cap)) - F.col("s")), 6).alias("remaining_usd"),
    )


def run_summary(calls: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Calls, cache hits, failures, tokens, dollars and latency of live calls per group.

    Where ``calls`` has them, ``error`` (text), ``invalid_output`` (boolean) and
    ``unalignable_components`` (count) are summed up; a run without them had none.
    """
    keys = list(keys)
    live = ~F.col("cached")
    none = {"error": "string", "invalid_output": "boolean", "unalignable_components": "bigint"}
    calls = calls.select("*", *(F.lit(None).cast(t).alias(c) for c, t in none.items() if c not in calls.columns))
    base = calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(live).alias("api_calls"),
        F.count_if(F.col("cached")).alias("cache_hits"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"),
        F.count_if("invalid_output").alias("invalid_outputs"),
        F.coalesce(F.sum("unalignable_components"), F.lit(0)).cast("bigint").alias("unalignable_components"),
        F.count_if(live).alias("latency_n"),
        *[
            F.sum(c).alias(c)
            for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
        ],
        F.bround(exact_sum(F.col("dollars")), 6).alias("dollars_total"),
        F.bround(exact_sum(F.col("dollars")) / F.count(F.lit(1)), 6).alias("dollars_per_doc"),
        F.bround(F.coalesce(
            exact_sum(F.when(live, F.col("latency_s")), 6) / F.count_if(live), F.lit(0.0)
        ), 3).alias("latency_mean"),
    )
    ranks = {f"latency_p{q}": lower_rank(q / 100) for q in (50, 95, 99)}
    spread = values_at_ranks(calls.filter(live), keys, "latency_s", ranks)
    tail = [F.bround(F.coalesce(c, F.lit(0.0)), 3).alias(c) for c in ranks]
    return base.join(spread, keys, "left").select(*base.columns, *tail)


def admission(calls: DataFrame, cap: float, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Which calls a spend cap lets through, in time order.

    A call is refused when the dollars spent before it plus its projected price
    pass the cap; the first refusal ends the run. Running totals go over ranges of
    the order, so no task sees the whole ledger, nor all calls of one moment.
    """
    # sums of exact decimals: the running total is the same however rows are grouped
    amount = F.coalesce(F.col("dollars"), F.lit(0)).cast("decimal(38,12)")
    marked = running(calls, order, amount, "spent").withColumn("spent_before", F.col("spent").cast("double"))
    marked = marked.withColumn("refused", F.col("spent_before") + F.col("projected") > F.lit(float(cap)))
    place = F.struct(*order)
    first = marked.filter("refused").agg(F.min(place)).scalar()
    return marked.withColumn("admitted", F.coalesce(place < first, F.lit(True))).select(
        *order, "model", "spent_before", "projected", "admitted"
    )


def projected_price(model: Column, chars: Column, max_tokens: int) -> Column:
    return price(model, F.floor(chars / 3), F.lit(max_tokens))


def local_usd_per_doc(docs_per_second: Column) -> Column:
    """GPU rental over measured throughput; nothing measured costs nothing."""
    return F.when(
        docs_per_second > 0, F.lit(GPU_USD_PER_HOUR) / (docs_per_second * F.lit(3600.0))
    ).otherwise(F.lit(0.0))


def cache_stats(requests: DataFrame, key: str = "key") -> DataFrame:
    """Hits and misses of an unbounded cache: only the first request of a key misses."""
    seen = requests.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total, misses = F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))
    return seen.agg(total.alias("total"), misses.alias("misses")).select(
        (F.col("total") - F.col("misses")).alias("hits"),
        "misses",
        F.when(
            F.col("total") > 0,
            F.bround((F.col("total") - F.col("misses")) / F.col("total"), 4),
        ).otherwise(F.lit(0.0)).alias("hit_rate"),
    )


def request_rollup(log: DataFrame, level: str = "concurrency") -> DataFrame:
    """Requests, failures, rate and latency per concurrency level."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = F.max(at) - F.min(at)
    base = log.groupBy(level).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("failed").alias("failures"),
        (seconds / 1e6).alias("span_s"),
        F.bround(F.sum("latency_ms") / F.count(F.lit(1)) / 1000, 3).alias("mean_s"),
        F.bround(F.max("latency_ms") / 1000, 3).alias("max_s"),
    )
    ranks = {f"p{q}_s": lower_rank(q / 100) for q in (50, 95, 99)}
    spread = values_at_ranks(log, [level], "latency_ms", ranks)
    rps = F.when(F.col("span_s") > 0, F.bround(F.col("requests") / F.col("span_s"), 6)).otherwise(0.0)
    return base.join(spread, level).select(
        level, "requests", "failures", rps.alias("rps"), "mean_s", "max_s",
        *[F.bround(F.col(c) / 1000, 3).alias(c) for c in ranks],
    )
