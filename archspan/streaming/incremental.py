"""Structured Streaming: counts of arriving edges and incremental orphan detection."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspan.operators import orphans
from archspan.runtime import shared_dir


def stream_table(spark: SparkSession, sf_dir: str, table: str, files_per_batch: int = 100) -> DataFrame:
    """A parquet table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{table}*")


def daily_edges(edges: DataFrame) -> DataFrame:
    """Edges per day and kind, (day, kind, n), of a table or of one micro-batch."""
    return edges.groupBy(F.to_date("loaded_at").alias("day"), F.upper(F.trim("kind")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def windowed_edges(edges: DataFrame, lateness: str) -> DataFrame:
    """The same as a windowed stream aggregation: a day is final, and its state is released, ``lateness`` after it.

    Rows later than that are dropped by the watermark; where none may be lost, use `accumulate`.
    """
    timed = edges.withColumn("at", F.col("loaded_at").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", "1 day").alias("w"), F.upper(F.trim("kind")).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "kind", "n")


def accumulate(spark: SparkSession, stream: DataFrame, root: str | None = None) -> DataFrame:
    """Drives a stream of edges over all that has arrived and returns the counts of all batches so far under ``root``.

    Every micro-batch writes its partial counts into a folder of its own, which a
    replayed batch overwrites; the sums are taken on reading. So no state is held,
    and a row counts however late it comes.
    """
    root = root or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, epoch: int) -> None:
        daily_edges(batch).write.mode("overwrite").parquet(f"{root}/parts/batch={epoch}")

    stream.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    parts = spark.read.schema("day date, kind string, n bigint").parquet(f"{root}/parts")
    return parts.groupBy("day", "kind").agg(F.sum("n").alias("n"))


def orphan_stream(spark: SparkSession, rules: DataFrame, nodes: DataFrame, out: str, state: str):
    """Checks each micro-batch of arriving rules against the node table and appends the orphans; a replayed batch overwrites its own folder."""

    def check(batch: DataFrame, epoch: int) -> None:
        orphans.orphan_references(batch, nodes).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return rules.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(check).start()
