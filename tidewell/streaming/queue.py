"""Streams: high-water-mark ingest, deduplication within a watermark, windowed counts, heartbeats, change journals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def newer_than(df: DataFrame, source: str, key: str, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows above each source's mark, the new marks): the batch form of high-water-mark ingest."""
    m = marks.select(source, F.col("mark"))
    fresh = df.join(m, source, "left").where(F.col("mark").isNull() | (F.col(key) > F.col("mark"))).drop("mark")
    top = fresh.groupBy(source).agg(F.max(key).alias("top"))
    return fresh, m.join(top, source, "full_outer").select(source, F.greatest("mark", "top").alias("mark"))


def read_files(spark: SparkSession, path: str, schema, per_trigger: int | None = None, pattern: str | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.parquet(path)


def deduplicated(stream: DataFrame, keys: list[str], stamp: str, late: str = "10 minutes") -> DataFrame:
    """First arrival of each key; keys are remembered for as long as late rows are let in."""
    return stream.withWatermark(stamp, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, stamp: str, by: list[str], width: str, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(stamp, late).groupBy(F.window(stamp, width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, stamp: str, by: str, gap: str, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(stamp, late).groupBy(F.session_window(stamp, gap), by).agg(F.count("*").alias("n"))


def heartbeats(stream: DataFrame, key: str, stamp: str) -> DataFrame:
    """When each key was last seen."""
    return stream.groupBy(key).agg(F.max(stamp).alias("last_seen"))


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Works off what is there and ends; files and checkpoint make the sink exactly-once."""
    df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_batches(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    q = df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_complete(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Works off what is there; the state after the last batch. Each batch writes the whole state under its number, so one
    that is replayed writes the same again, and a run without anything new has the state of the run before."""
    spark = df.sparkSession

    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    run_batches(df, each, checkpoint, "complete")
    names = df.columns
    try:
        states = spark.read.parquet(path)
    except AnalysisException:  # there has been no batch at all
        return spark.createDataFrame([], df.schema)
    return states.join(F.broadcast(states.agg(F.max("batch").alias("batch"))), "batch").select(*names)


def upsert_batches(stream: DataFrame, state_path: str, keys: list[str], order: list[Column], checkpoint: str) -> None:
    """Keeps a table of each key's latest row. Each batch writes the state anew under its number, so a batch that is
    replayed writes the same state again."""
    from ..operators.rank import keep_best
    from ..operators.upsert import upsert

    def each(batch: DataFrame, n: int) -> None:
        new = keep_best(batch, keys, order)
        if n:
            new = upsert(batch.sparkSession.read.parquet(f"{state_path}/{n - 1}"), new, keys)
        new.write.mode("overwrite").parquet(f"{state_path}/{n}")

    run_batches(stream, each, checkpoint, "append")
