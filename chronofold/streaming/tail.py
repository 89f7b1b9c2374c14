"""Reactive reads: a log folder as a stream, subscribers, and the running fold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tail(spark: SparkSession, path: str, schema: str, source: str = "parquet") -> DataFrame:
    """New rows of a folder as they come; the checkpoint of the query remembers how far it has read."""
    return spark.readStream.schema(schema).format(source).load(path)


def subscribe(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Call handler with each batch, in order of seq if there is one; query.stop() ends it."""

    def run(batch: DataFrame, epoch: int) -> None:
        handler(batch.orderBy("seq") if "seq" in batch.columns else batch, epoch)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_assign(stream: DataFrame) -> DataFrame:
    """(log, k, v): last value of each field so far, from a stream of (log, seq, k, v)."""
    return stream.groupBy("log", "k").agg(F.max_by(F.struct("v"), "seq").alias("s")).select("log", "k", "s.v")


def windows(stream: DataFrame, time: str, length: str, slide: str | None = None, late: str = "10 minutes", *keys: str) -> DataFrame:
    """Counts by event-time window, late rows allowed for."""
    by = F.window(time, length, slide) if slide else F.window(time, length)
    return stream.withWatermark(time, late).groupBy(by, *keys).agg(F.count(F.lit(1)).alias("n"))


def settle_stream(commands: DataFrame, results: DataFrame, within: str = "30 seconds") -> DataFrame:
    """Stream-stream join of commands (key, ts) with results (prev, result_ts) that refer to them in time."""
    c, r = commands.withWatermark("ts", within), results.withWatermark("result_ts", within)
    return c.join(r, F.expr(f"key = prev AND result_ts >= ts AND result_ts <= ts + interval {within}"))
