"""The index of a log: which keys of each bit level are taken, where a level lies in the file, and how often it is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys

VERSION, DENSE = 1, 20  # levels above DENSE are kept as a list of positions, not as a bitmap


def entries(log: DataFrame) -> DataFrame:
    """(log, level, bits, position): each stored key's bits, and their value within its level."""
    bits = keys.to_bits(F.col("key"))
    held = log.select("log", F.explode(F.array("key")).alias("key")).where(F.col("key").isNotNull())  # a key that is worked out is so once, not in the filter too
    own = held.select("log", bits.alias("bits")).distinct()
    return own.select("log", F.length("bits").alias("level"), "bits", F.coalesce(F.conv("bits", 2, 10).cast("decimal(20,0)"), F.lit(0)).alias("position"))


def levels(index: DataFrame) -> DataFrame:
    """(log, level, count, closed), by level; a level is closed when all of its keys are taken."""
    out = index.groupBy("log", "level").agg(F.count_distinct("position").alias("count"))
    return out.withColumn("closed", F.col("count") >= F.pow(F.lit(2.0), "level")).orderBy("log", "level")


def total(index: DataFrame) -> DataFrame:
    return index.groupBy("log").agg(F.count_distinct("level", "position").alias("count"))


def add(index: DataFrame, more: DataFrame) -> DataFrame:
    """The index with more of its rows, each once."""
    return index.unionByName(more).distinct()


def has(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (log, bits) with taken: whether these very bits are."""
    return wanted.join(index.select("log", "bits", F.lit(True).alias("__t")), ["log", "bits"], "left").withColumn("taken", F.coalesce("__t", F.lit(False))).drop("__t")


def lookup(index: DataFrame, wanted: DataFrame, upto: int = 64) -> DataFrame:
    """wanted (log, bits) with found, the shortest taken prefix of at most upto bits.

    Each prefix is a row joined by equality, so no wanted key is compared with all taken ones.
    """
    each = wanted.withColumn("__n", F.explode(F.sequence(F.lit(1), F.least(F.length("bits"), F.lit(upto)))))
    each = each.withColumn("__p", F.substring(F.col("bits"), F.lit(1), F.col("__n")))
    hit = each.join(index.select(F.col("log"), F.col("bits").alias("__p"), F.lit(True).alias("__t")), ["log", "__p"], "left")
    return hit.groupBy(*wanted.columns).agg(F.min_by("__p", F.when(F.col("__t"), F.col("__n"))).alias("found"))


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once: in the body of a lambda function it would be for each of its elements."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _bitmap(marks: Column) -> Column:
    """The base64 of a bitmap, from its bytes that are not zero: structs (at, b), in order of at."""
    gap = lambda x, i: (x["at"] - F.coalesce(F.get(marks, i - 1)["at"] + 1, F.lit(0))).cast("int")
    text = F.array_join(F.transform(marks, lambda x, i: F.concat(F.repeat(F.lit("00"), gap(x, i)), F.lpad(F.hex(x["b"]), 2, "0"))), "")
    return F.replace(F.base64(F.unhex(text)), F.lit("\r\n"), F.lit(""))


def _marks(raw: Column) -> Column:
    """The bytes of a bitmap that are not zero: structs (at, b). Runs of zero bytes are passed over in ever shorter steps."""
    spots, last = F.array(F.lit(0)), F.greatest(F.length(raw) - 1, F.lit(0))
    within = lambda i, width, step: F.filter(F.sequence(i, F.least(i + (width - 1), last), F.lit(step)), lambda j: F.substring(raw, j + 1, F.lit(step)) > F.lit(bytes(step)))
    for width, step in ((1 << 30, 4096), (4096, 256), (256, 16), (16, 1)):
        spots = F.flatten(F.transform(spots, lambda i: within(i, width, step)))
    return F.transform(spots, lambda i: F.struct(i.alias("at"), F.conv(F.hex(F.substring(raw, i + 1, F.lit(1))), 16, 10).cast("int").alias("b")))


def to_lines(index: DataFrame) -> DataFrame:
    """(log, level, line): a header line (level 0) and one line a level: `level:b:base64` of a little-endian bitmap up to
    level DENSE, above it `level:s:` and the positions.

    Each key gives a mark to its level (a bit of a byte, or a position) and its level to the header, all in one pass.
    """
    n, dense = F.col("position").cast("long"), F.col("level") <= DENSE
    at = F.when(dense, F.shiftright(n, 3).cast("decimal(20,0)")).otherwise(F.col("position").cast("decimal(20,0)"))
    bit = F.when(dense, F.call_function("shiftleft", F.lit(1), n.bitwiseAND(F.lit(7)).cast("int")))
    own = F.struct(F.lit(False).alias("head"), "level", at.alias("at"), bit.alias("b"))
    top = F.struct(F.lit(True).alias("head"), F.lit(0).alias("level"), F.col("level").cast("decimal(20,0)").alias("at"), F.lit(None).cast("int").alias("b"))
    marks = index.select("log", F.inline(F.array(own, top))).groupBy("log", "head", "level", "at").agg(F.bit_or("b").alias("b"))
    each = marks.groupBy("log", "head", "level").agg(F.sort_array(F.collect_list(F.struct("at", "b"))).alias("m"))
    positions = F.array_join(F.transform("m", lambda x: x["at"].cast("string")), ",")
    line = F.when(F.col("head"), F.concat(F.lit(f"index v{VERSION} levels "), F.element_at("m", -1)["at"].cast("string")))
    line = line.when(dense, F.concat(F.col("level"), F.lit(":b:"), _let(F.col("m"), _bitmap))).otherwise(F.concat(F.col("level"), F.lit(":s:"), positions))
    return each.select("log", "level", line.alias("line"))


def from_lines(lines: DataFrame) -> DataFrame:
    """The index (log, level, bits, position) of its lines; lines that cannot be read are skipped, and so is every line of a
    log whose header is missing or of another version (its index has to be built anew)."""
    form, text = r"^\d+:([bs]):(.*)$", F.lit(None).cast("string")
    ok = F.max(F.col("line").startswith(f"index v{VERSION} ")).over(Window.partitionBy("log"))
    got = lines.select("log", "line", ok.alias("__ok")).where("__ok").select("log", F.regexp_extract("line", r"^(\d+):", 1).try_cast("int").alias("level"), F.regexp_extract("line", form, 1).alias("p"), F.regexp_extract("line", form, 2).alias("d"))
    dense = F.transform(_let(F.try_to_binary("d", F.lit("base64")), _marks), lambda x: F.struct(x["at"].alias("at"), x["b"].alias("b"), text.alias("x")))
    sparse = F.transform(F.split("d", ","), lambda x: F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("b"), x.alias("x")))
    marks = got.where(F.col("level") > 0).select("log", "level", F.inline(F.when(F.col("p") == "b", dense).when(F.col("p") == "s", sparse)))
    bits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.when(F.call_function("shiftright", F.col("b"), k).bitwiseAND(F.lit(1)) == 1, F.col("at") * 8 + k)), lambda x: x.isNotNull())
    each = F.when(F.col("x").isNull(), F.transform(bits, lambda x: x.cast("decimal(20,0)"))).otherwise(F.array(F.col("x").try_cast("decimal(20,0)")))
    out = marks.select("log", "level", F.explode(each).alias("position")).where(F.col("position").isNotNull())
    return out.select("log", "level", F.lpad(F.conv(F.col("position").cast("string"), 10, 2), F.col("level"), F.lit("0")).alias("bits"), "position")


def offsets(log: DataFrame) -> DataFrame:
    """log with offset and size, the bytes of its hashed line in its file."""
    size = F.octet_length(F.concat("payload", F.lit("#"), "key")) + 1
    w = Window.partitionBy("log").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("size", size.cast("long")).withColumn("offset", F.sum("size").over(w) - F.col("size"))


def extents(log: DataFrame) -> DataFrame:
    """(log, level, first, last, count): from where to where the lines of each bit level lie."""
    return offsets(log).groupBy("log", keys.level_of(F.col("key")).alias("level")).agg(F.min("offset").alias("first"), F.max(F.col("offset") + F.col("size")).alias("last"), F.count(F.lit(1)).alias("count"))


def find_in_extent(log: DataFrame, key: str) -> DataFrame:
    """The record of a key, of the rows of its level only (a log partitioned by level reads that partition alone)."""
    level = len(keys.py_bits(key))
    own = log.where(F.col("level") == level) if "level" in log.columns else log.where(keys.level_of(F.col("key")) == level)
    return own.where(F.col("key") == key)


def write_stats(log: DataFrame, time: str = "ts") -> DataFrame:
    """(log, count, mean, m2, variance, last) of the gaps between writes; time: a number or a timestamp (then in seconds)."""
    kind = log.schema[time].dataType.simpleString()
    t = F.col(time).cast("timestamp").cast("double") if kind.startswith("timestamp") else F.col(time).cast("double")
    gap = log.select("log", t.alias("t"), (t - F.lag(t).over(Window.partitionBy("log").orderBy("seq"))).alias("gap"))
    n = F.count("gap")
    return gap.groupBy("log").agg(n.alias("count"), F.avg("gap").alias("mean"), (F.var_pop("gap") * n).alias("m2"), F.var_samp("gap").alias("variance"), F.max("t").alias("last"))


def depth_histogram(log: DataFrame) -> DataFrame:
    """(log, level, count, percent) of the keys that are not reserved."""
    out = log.where(~F.col("key").isin(*keys.RESERVED)).groupBy("log", keys.level_of(F.col("key")).alias("level")).agg(F.count(F.lit(1)).alias("count"))
    return out.withColumn("percent", F.round(100.0 * F.col("count") / F.sum("count").over(Window.partitionBy("log")), 6))
