"""Chains: allocation of keys (sequential by log) and their verification (one window)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys


RANGE = 1 << 20


def with_previous(log: DataFrame, span: int = RANGE) -> DataFrame:
    """log with before, the key of the record before each in its log.

    A log is dealt to ranges of seq, so a long one is many tasks; what a range hands to the next is one row.
    """
    ranged = log.withColumn("__range", F.floor(F.col("seq") / span))
    here = Window.partitionBy("log", "__range").orderBy("seq")
    ends = ranged.groupBy("log", "__range").agg(F.max_by("key", "seq").alias("__last"))
    handed = ends.select("log", "__range", F.lag("__last").over(Window.partitionBy("log").orderBy("__range")).alias("__handed"))
    first = F.row_number().over(here) == 1
    out = ranged.withColumn("__lag", F.lag("key").over(here)).withColumn("__first", first).join(handed, ["log", "__range"])
    return out.withColumn("before", F.when(F.col("__first"), F.col("__handed")).otherwise(F.col("__lag"))).drop("__range", "__lag", "__first", "__handed")


def audit(log: DataFrame) -> DataFrame:
    """log with bad: whether the bits of a key do not lead those of sha64(payload) XOR sha64(key before it)."""
    bits = keys.key_bits(keys.full_key(F.col("payload"), F.col("before")))
    content = ~F.col("key").isin(*keys.RESERVED)
    return with_previous(log).withColumn("bad", content & ~F.coalesce(bits.startswith(keys.to_bits(F.col("key"))), F.lit(False)))


def verify(log: DataFrame) -> DataFrame:
    """(log, valid, length, failed_at, failures, duplicates) of each log; log: (log, seq, key, payload).

    Payloads are hashed as canonical JSON, in whatever order they are stored.  Reserved keys are not checked.
    """
    out = audit(log).groupBy("log").agg(
        F.count(F.lit(1)).alias("length"),
        F.min(F.when(F.col("bad"), F.col("seq"))).alias("failed_at"),
        F.sum(F.col("bad").cast("long")).alias("failures"),
        (F.count("key") - F.count_distinct("key")).alias("duplicates"),
    )
    return out.select("log", (F.col("failures") == 0).alias("valid"), "length", "failed_at", "failures", "duplicates")


def _allocated(rows: DataFrame) -> DataFrame:
    """Keys of the rows (log, seq, hash, old) that have no old one, in order; old ones are taken before.

    Allocation is sequential: a log is one task, which streams its rows and holds only its taken prefixes.
    """
    import pyarrow as pa

    kind = rows.schema["log"].dataType.simpleString()

    def run(batches):
        log, own, before = None, None, None
        for batch in batches:
            logs, seqs, hashes, olds = (batch.column(c).to_pylist() for c in ("log", "seq", "hash", "old"))
            out = []
            for name, h, old in zip(logs, hashes, olds, strict=True):
                if own is None or name != log:
                    log, own, before = name, keys.Allocator(), None
                if old is None:
                    old = own.allocate(format((h & (1 << 64) - 1) ^ keys.py_sha64(before), "064b"))
                else:
                    own.take(keys.py_bits(old))
                before = old
                out.append(old)
            keep = pa.array([x is None for x in olds])
            yield pa.RecordBatch.from_arrays([batch.column("log"), batch.column("seq"), pa.array(out, pa.string())], names=["log", "seq", "key"]).filter(keep)

    dealt = rows.repartition("log").sortWithinPartitions("log", "seq")
    return dealt.mapInArrow(run, f"log {kind}, seq long, key string")


def extend_chain(log: DataFrame | None, rows: DataFrame) -> DataFrame:
    """The records (log, seq, key, payload) that appending rows (log, seq, payload) adds to log; log itself is not rewritten.

    Of the log only seq and key are read.  Rows go behind it in their own order.
    """
    rows = rows.select("log", F.col("seq").cast("long").alias("seq"), "payload")
    new = rows.select("log", "seq", keys.sha64(keys.hash_text(F.col("payload"))).alias("hash"), F.lit(None).cast("string").alias("old"))
    if log is not None:
        touched = rows.select("log").distinct()
        old = log.select("log", F.col("seq").cast("long").alias("seq"), F.lit(0).cast("long").alias("hash"), F.col("key").alias("old")).join(touched, "log", "left_semi")
        new = old.unionByName(new)
    return _allocated(new).join(rows, ["log", "seq"]).select("log", "seq", "key", "payload")


def genesis(rows: DataFrame, entity: str = "log") -> DataFrame:
    """The two reserved records of each log of rows, behind whose first seq they lie."""
    first = rows.groupBy("log").agg(F.min("seq").cast("long").alias("first"))
    name = F.col("log").cast("string")
    header = F.to_json(F.struct(name.alias("_entity"), F.lit(entity).alias("_type")))
    pair = F.array(F.struct((F.col("first") - 2).alias("seq"), F.lit("0").alias("key"), header.alias("payload")), F.struct((F.col("first") - 1).alias("seq"), F.lit("1").alias("key"), F.to_json(F.struct(name.alias("_projection"))).alias("payload")))
    return first.select("log", F.inline(pair))


def write_chain(rows: DataFrame, entity: str = "log") -> DataFrame:
    """(log, seq, key, payload): rows (log, seq, payload) behind a genesis pair '0' and '1', with allocated keys."""
    head = genesis(rows, entity)
    return head.unionByName(extend_chain(head, rows))


def levels(log: DataFrame) -> DataFrame:
    """(log, level, count, closed): keys by bit length; a level is closed when all of its keys are taken."""
    out = log.groupBy("log", keys.level_of(F.col("key")).alias("level")).agg(F.count_distinct("key").alias("count"))
    return out.withColumn("closed", F.col("count") >= keys.capacity(F.col("level")))


def settle(commands: DataFrame, results: DataFrame) -> DataFrame:
    """Each command with its first later result whose _prev or _ref is the command's key; null if none came.

    commands: (key, seq) and more; results: (key, seq, prev, ref).  Both lie in one window by key: each command looks at
    the least result behind it, so a key with many commands and results is sorted, not paired.
    """
    refs = results.select(F.col("key").alias("result_key"), F.col("seq").alias("result_seq"), F.explode(F.array_compact(F.array_distinct(F.array("prev", "ref")))).alias("to"))
    own = commands.select(F.col("key").alias("__k"), F.col("seq").alias("__s"), F.lit(1).alias("__c"), F.struct(*commands.columns).alias("__row"), F.lit(None).cast(results.select(F.struct(F.col("seq"), F.col("key"))).schema[0].dataType).alias("__r"))
    other = refs.select(F.col("to").alias("__k"), F.col("result_seq").alias("__s"), F.lit(0).alias("__c"), F.lit(None).cast(own.schema["__row"].dataType).alias("__row"), F.struct(F.col("result_seq").alias("seq"), F.col("result_key").alias("key")).alias("__r"))
    behind = Window.partitionBy("__k").orderBy("__s", "__c").rowsBetween(1, Window.unboundedFollowing)
    found = own.unionByName(other).withColumn("__f", F.min("__r").over(behind)).where("__c = 1")
    return found.select("__row.*", F.col("__f.seq").alias("result_seq"), F.col("__f.key").alias("result_key"))


def descendants(links: DataFrame, root: object, rounds: int = 10_000) -> DataFrame:
    """(key, depth): all records below root by links (key, prev); distributed breadth-first search.

    A round is one level; each is cut from its lineage by a checkpoint if the session has a folder for it.  More rounds
    than `rounds` raise.
    """
    spark = links.sparkSession
    cut = (lambda df: df.checkpoint()) if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else (lambda df: df)
    found = edge = cut(links.where(F.col("prev") == F.lit(root)).select("key", F.lit(1).alias("depth")).distinct())
    for depth in range(2, rounds + 1):
        edge = links.join(edge.select(F.col("key").alias("up")), F.col("prev") == F.col("up")).select("key", F.lit(depth).alias("depth")).distinct().join(found.select("key"), "key", "left_anti")
        edge = cut(edge)
        if edge.isEmpty():
            return found
        found = found.unionByName(edge)
    raise RuntimeError(f"more than {rounds} levels of descendants")


def settle_ancestry(records: DataFrame, token: object, actor: str = "ai.") -> DataFrame:
    """The first record after the token that descends from it and is a result, or comes from an actor.

    records: (key, seq, prev, type, source).
    """
    at = records.where(F.col("key") == F.lit(token)).select(F.col("seq").alias("since"))
    below = descendants(records.select("key", "prev"), token).select("key", F.lit(True).alias("below"))
    seen = records.join(below, "key", "left").join(F.broadcast(at), F.col("seq") > F.col("since"))
    return seen.where((F.col("below") & (F.col("type") == "result")) | F.coalesce(F.col("source").startswith(actor), F.lit(False))).orderBy("seq").limit(1).select(*records.columns)


def parents(log: DataFrame, previous: DataFrame) -> DataFrame:
    """(log, seq, parent): the record whose key a record's full key was made with, by an equi-join on the recovered hash.

    log: (log, seq, full, payload) with full 64-bit keys; previous: (log, seq, key).
    """
    want = log.select("log", "seq", keys.recover_previous(F.col("full"), F.col("payload")).alias("h"))
    have = previous.select("log", keys.sha64(F.col("key")).alias("h"), F.col("seq").alias("parent"))
    return want.join(have, ["log", "h"], "left").select("log", "seq", "parent")


def inherited(types: DataFrame, fields: DataFrame) -> DataFrame:
    """(name, field, value): fields of each type and of its ancestors, the farthest ancestor's definition first.

    types: (name, parent); fields: (name, field, value).
    """
    up = types.select("name", F.col("name").alias("at"), "parent", F.lit(0).alias("depth"))
    chain_ = up
    while not (up := up.join(types.select(F.col("name").alias("p"), F.col("parent").alias("pp")), F.col("parent") == F.col("p")).select("name", F.col("p").alias("at"), F.col("pp").alias("parent"), (F.col("depth") + 1).alias("depth"))).isEmpty():
        chain_ = chain_.unionByName(up)
        if up.agg(F.max("depth")).first()[0] > 1000:
            raise ValueError("types inherit in a circle")
    own = fields.select(F.col("name").alias("at"), "field", "value")
    return chain_.join(own, "at").groupBy("name", "field").agg(F.max_by("value", "depth").alias("value"))


def same_log(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in which two logs differ, with the side that holds them."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
