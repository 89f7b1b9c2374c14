"""Reducers: the state of each log as a relational fold of its records.

A log table has (log, seq, payload), payload being JSON text; seq gives the order.  Every fold is one shuffle by
log and key; no log is gathered into one task but by ``append`` and ``custom``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fields(log: DataFrame) -> DataFrame:
    """(log, seq, k, x): top-level fields of each payload, x as a variant.

    A payload that is no object is a field named by its record's key, if there is a key.
    """
    found = F.from_json("payload", "map<string,variant>")
    if "key" in log.columns:
        whole = F.when(F.col("key").isNotNull() & F.try_parse_json("payload").isNotNull(), F.create_map(F.col("key"), F.parse_json("payload")))
        found = F.when(F.ltrim("payload").startswith("{"), found).otherwise(whole)
    return log.select("log", "seq", F.explode(found).alias("k", "x"))


def entries(log: DataFrame) -> DataFrame:
    """(log, seq, k, v): top-level fields of each payload, v as JSON text: strings keep their quotes, JSON null is null."""
    return fields(log).select("log", "seq", "k", F.coalesce(F.to_json("x"), F.lit("null")).alias("v"))


def _last(value: Column, seq: str = "seq") -> Column:
    return F.max_by(F.struct(value.alias("v")), F.col(seq))["v"]


def assign(log: DataFrame) -> DataFrame:
    """(log, k, v): last value of each top-level field; null is a value."""
    last = fields(log).groupBy("log", "k").agg(_last(F.col("x")).alias("x"))  # text is made of the last values only
    return last.select("log", "k", F.coalesce(F.to_json("x"), F.lit("null")).alias("v"))


def merge(log: DataFrame) -> DataFrame:
    """(log, k, sub, v): null deletes a field, an object merges one level deep, anything else replaces.

    sub is null for a field that holds no object, or an empty one.  What counts for a field are the events after its last
    reset (a null, scalar or array).  One pass over the fields: the last reset of a field is a window's maximum.
    """
    e = entries(log).withColumn("is_object", F.col("v").startswith("{"))
    w = Window.partitionBy("log", "k")
    e = e.withColumn("reset", F.max(F.when(~F.col("is_object"), F.col("seq"))).over(w))
    live = e.where(F.col("reset").isNull() | (F.col("seq") >= F.col("reset")))
    none = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("variant").alias("value")))
    fields = F.map_entries(F.from_json("v", "map<string,variant>"))
    subs = live.withColumn("s", F.explode(F.when(F.col("is_object") & (F.size(fields) > 0), fields).otherwise(none)))
    subs = subs.select("log", "k", "seq", F.col("s.key").alias("sub"), F.when(F.col("s.key").isNull(), F.col("v")).otherwise(F.coalesce(F.to_json("s.value"), F.lit("null"))).alias("v"))
    last = subs.groupBy("log", "k", "sub").agg(_last(F.col("v")).alias("v"), F.max("seq").alias("seq"))
    # A field's own row stays only if it holds no sub-field.
    held = last.withColumn("subs", F.count("sub").over(w))
    return held.where(F.col("sub").isNotNull() | ((F.col("subs") == 0) & (F.col("v") != "null"))).select("log", "k", "sub", "v")


def leaves(log: DataFrame, separator: str = "/") -> DataFrame:
    """(log, seq, path, steps, v): every leaf of each payload, at any depth, v as JSON text; keys that hold the separator
    are paths; an empty object is a leaf; payloads that are no object are left out.  One Arrow pass."""
    import pyarrow as pa

    kind = log.schema["log"].dataType.simpleString()

    def run(batches):
        import json

        for batch in batches:
            at, steps, values = [], [], []
            for i, payload in enumerate(batch.column("payload").to_pylist()):
                try:
                    doc = json.loads(payload or "null")
                except ValueError:
                    continue
                stack = [((), doc)] if isinstance(doc, dict) else []
                while stack:
                    path, x = stack.pop()
                    if isinstance(x, dict) and x:
                        stack += [((*path, *(s for s in k.split(separator) if s)), v) for k, v in reversed(x.items())]
                    elif path:
                        at.append(i)
                        steps.append(list(path))
                        values.append(json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True))
            rows = batch.select(["log", "seq"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([separator.join(s) for s in steps], pa.string()), pa.array(steps, pa.list_(pa.string())), pa.array(values, pa.string())], names=["log", "seq", "path", "steps", "v"])

    return log.select("log", F.col("seq").cast("long").alias("seq"), "payload").mapInArrow(run, f"log {kind}, seq long, path string, steps array<string>, v string")


def deep_merge(log: DataFrame, separator: str = "/") -> DataFrame:
    """(log, path, v): recursive merge; null deletes at any depth, arrays and scalars replace, path keys expand.

    A leaf stays if no later event ends at its path, at one of its ancestors, or (for a value under an object) below it.
    An empty object replaces a scalar but leaves an object as it is.
    """
    all_ = leaves(log, separator)
    last = all_.groupBy("log", "path", "steps").agg(F.max("seq").alias("seq"), _last(F.col("v")).alias("v"), F.max(F.when(F.col("v") != "{}", F.col("seq"))).alias("end_seq"))
    above = F.transform(F.sequence(F.lit(1), F.size("steps")), lambda i: F.struct(F.array_join(F.slice("steps", F.lit(1), i), separator).alias("up"), (i < F.size("steps")).alias("proper")))
    # One row for a leaf at each of its ancestors and one at itself; a window by that place holds all that can bury or open it.
    spread = last.select("log", "path", "seq", "v", "end_seq", F.inline(above))
    place = Window.partitionBy("log", "up")
    spread = spread.withColumn("ended", F.max(F.when(~F.col("proper"), F.col("end_seq"))).over(place)).withColumn("opened", F.max(F.when(F.col("proper"), F.col("seq"))).over(place))
    gone = (F.col("proper") & (F.col("ended") > F.col("seq"))) | (~F.col("proper") & (F.col("opened") > F.col("seq")))
    out = spread.groupBy("log", "path").agg(F.max("v").alias("v"), F.bool_or(F.coalesce(gone, F.lit(False))).alias("gone"))
    return out.where(~F.col("gone") & (F.col("v") != "null")).select("log", "path", "v")


def append(log: DataFrame) -> DataFrame:
    """(log, records): all payloads in order."""
    return log.groupBy("log").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "payload"))), lambda r: r["payload"]).alias("records"))


def upsert_by_id(rows: DataFrame, id_column: str, seq: str = "seq") -> DataFrame:
    """Last row of each id; rows without an id are left out."""
    rest = [c for c in rows.columns if c != id_column]
    latest = rows.where(F.col(id_column).isNotNull()).groupBy(id_column).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r"))
    return latest.select(id_column, *[F.col(f"r.{c}").alias(c) for c in rest])


def membership(log: DataFrame) -> DataFrame:
    """(log, k, v): records by key, last wins."""
    return log.groupBy("log", F.col("key").alias("k")).agg(_last(F.col("payload")).alias("v"))


def fill_missing(left: DataFrame, right: DataFrame, on: list[str], value: str = "v") -> DataFrame:
    """left, with the keys that only right has."""
    r = right.select(*on, F.col(value).alias("__r"))
    return left.select(*on, F.col(value).alias("__l")).join(r, on, "full").select(*on, F.coalesce("__l", "__r").alias(value))


def custom(log: DataFrame, reduce: Callable, initial: object, schema: str) -> DataFrame:
    """A user's reduce(state, payload) over each log, in order, as one row {log, **state}.

    A log is one task, which streams its rows and holds only the state.
    """
    import pyarrow as pa

    def run(batches):
        import copy
        import json

        log_, state = None, None
        started = False
        for batch in batches:
            out = []
            for name, payload in zip(batch.column("log").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if not started or name != log_:
                    if started:
                        out.append({"log": log_, **state})
                    log_, state, started = name, copy.deepcopy(initial), True
                state = reduce(state, json.loads(payload))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if started:
            yield pa.RecordBatch.from_pylist([{"log": log_, **state}], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return log.repartition("log").sortWithinPartitions("log", "seq").select("log", "payload").mapInArrow(run, schema)


def upsert_payloads(log: DataFrame) -> DataFrame:
    """(log, k, v): last payload of each payload.id; payloads without an id are left out."""
    own = log.withColumn("k", F.to_json(F.try_variant_get(F.try_parse_json("payload"), "$.id", "variant"))).where("k is not null")
    return own.groupBy("log", "k").agg(_last(F.col("payload")).alias("v"))


REDUCERS = {"assign": assign, "kv": assign, "merge": merge, "store": merge, "map": deep_merge, "table": upsert_payloads, "append": append, "stream": append, "bloom": membership}
