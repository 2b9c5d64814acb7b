"""Stage 1 over a growing folder of raw games, with the batch operator's own expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plyforge.operators.stage1 import tokenised


def stream(spark: SparkSession, source: str, like: DataFrame, min_elo: int = 1600, min_plies: int = 20) -> DataFrame:
    """The tokenised games of the files that appear in ``source``; ``like`` gives the schema."""
    return tokenised(spark.readStream.schema(like.schema).parquet(source), min_elo, min_plies)


def run_available(spark: SparkSession, source: str, like: DataFrame, target: str, checkpoint: str, **options) -> None:
    """Process what is there now and stop; started again, only new files are read, and each row is written once."""
    query = stream(spark, source, like, **options).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()
    query.awaitTermination()


def deduplicated(games: DataFrame, time: str = "ingested_at", key: str = "site", delay: str = "30 days") -> DataFrame:
    """One row per key within the delay, for games that are ingested again; state older than the watermark is dropped."""
    return games.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
