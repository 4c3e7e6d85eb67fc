"""Streams over the append-only ledger and over arriving generations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import schemas
from marginalia.functions.jsontext import parse_object
from marginalia.operators.cascade import escalates
from marginalia.session import scratch_path


def read_ledger(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.LEDGER)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(path)


def spend_by_model(ledger: DataFrame, cap: float) -> DataFrame:
    """Running spend per model and whether it passed the cap.

    State is one row per model. A restart continues from the checkpoint, so the
    total survives it.
    """
    spent = F.sum(F.coalesce("dollars", F.lit(0.0)).cast("decimal(38,12)")).cast("double")
    totals = ledger.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), spent.alias("s"))
    return totals.select(
        "model", "calls", F.bround("s", 6).alias("spent"), (F.col("s") > cap).alias("over_cap")
    )


def first_calls(calls: DataFrame, key: Sequence[str], within: tuple[str, str] | None = None) -> DataFrame:
    """Each key once, whatever times its rows carry: without ``within`` no row is ever late.

    Keys are remembered for good then. ``within`` = (event-time column, delay) bounds them, at
    the price of rows that come later than that after the newest time seen: use it only where
    every row is dated by the event itself.
    """
    if within is None:
        return calls.dropDuplicates(list(key))
    return calls.withWatermark(*within).dropDuplicatesWithinWatermark(list(key))


def route(generations: DataFrame, threshold: float) -> DataFrame:
    """Route every answer by its confidence, and count health per model and route."""
    routed = generations.withColumn("escalated", escalates(F.col("mean_logprob"), F.lit(threshold)))
    return routed.groupBy("model", "escalated").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(parse_object(F.col("answer")).isNull()).alias("unparsed"),
    )


def run_to_end(stream: DataFrame, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Process what is there, stop, and return all that the stream has put out so far.

    The output lies beside the checkpoint, so a restart adds to what earlier runs wrote,
    and one that finds nothing new returns it as it was. Every batch is written as a whole
    to its own folder: a retried batch replaces itself. Complete mode keeps the last batch.
    """
    spark = stream.sparkSession
    place = checkpoint or scratch_path(spark, "stream")
    out = f"{place}/output"

    def keep(batch: DataFrame, number: int) -> None:
        folder = "all" if mode == "complete" else f"batch={number}"
        batch.write.mode("overwrite").parquet(f"{out}/{folder}")

    started = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{place}/progress")
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    started.awaitTermination()
    empty = spark.createDataFrame([], stream.schema)
    try:
        result = spark.read.schema(stream.schema).parquet(f"{out}/all" if mode == "complete" else f"{out}/batch=*")
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty  # no batch was ever written
    return result
