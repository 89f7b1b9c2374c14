"""Channels: named events as rows (event, seq, payload), their subscribers, their last payload, and waiting for results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .tail import subscribe


def last(events: DataFrame, event: str | None = None, field: str | None = None) -> DataFrame:
    """(event, payload): the last payload of each channel, or a field of it."""
    own = events if event is None else events.where(F.col("event") == event)
    out = own.groupBy("event").agg(F.max_by("payload", "seq").alias("payload"))
    return out if field is None else out.withColumn("payload", F.to_json(F.try_variant_get(F.try_parse_json("payload"), f"$.{field}", "variant")))


def on(stream: DataFrame, event: str, handler: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """handler(batch, number) for the rows of one event, in order of seq; '*' is every event.  stop() ends it."""
    own = stream if event == "*" else stream.where(F.col("event") == event)
    return subscribe(own, handler, checkpoint, once)


def out(stream: DataFrame, logs: list[str] | None, handler: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """handler for the writes of some logs, or of all."""
    return subscribe(stream if logs is None else stream.where(F.col("log").isin(*logs)), handler, checkpoint, once)


def fan_out(stream: DataFrame, routes: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, column: str = "type", once: bool = False) -> StreamingQuery:
    """One query, several consumers: each handler gets the rows of its type ('*': all), from one read of the batch."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for kind, handler in routes.items():
                handler(batch if kind == "*" else batch.where(F.col(column) == kind), epoch)
        finally:
            batch.unpersist()

    return subscribe(stream, run, checkpoint, once)


def snapshot_every(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: int = 100, once: bool = False) -> StreamingQuery:
    """write(batch, number) after each `every` batches; what it writes is stale but whole until then."""
    return subscribe(stream, lambda batch, epoch: write(batch, epoch) if (epoch + 1) % every == 0 else None, checkpoint, once)


def session_records(stream: DataFrame, name: str) -> StreamingQuery:
    """The rows that came since the query began, as a table in memory (for inspection of small streams)."""
    return stream.writeStream.format("memory").queryName(name).outputMode("append").start()


def settle(commands: DataFrame, results: DataFrame, timeout_ms: int) -> DataFrame:
    """Commands (key, ts) with result: the first of results (key, prev, ref, type, ts) that refers to them and came within the
    time, else 'timeout'.  Batch form: on a finished log, waiting is a comparison of times."""
    own = results.where(F.col("type") == "result").select(F.col("key").alias("result"), F.col("ts").alias("at"), F.explode(F.array_compact(F.array_distinct(F.array("prev", "ref")))).alias("to"))
    hit = commands.join(own, (F.col("key") == F.col("to")) & (F.col("at") >= F.col("ts")) & (F.col("at") <= F.col("ts") + F.make_dt_interval(secs=F.lit(timeout_ms / 1000))), "left")
    return hit.groupBy(*commands.columns).agg(F.coalesce(F.min_by("result", F.struct("at", "result")), F.lit("timeout")).alias("result"))
