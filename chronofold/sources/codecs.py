"""Line formats of logs, and readers of small text formats, as DataFrame functions."""



import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: {payload}#key, split at the last # whose rest has no braces or blanks.
_HASHED = r"^(\{.*)#([^{}\s#]+)\s*$"


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with key and payload (JSON text): hashed lines, else {"key": payload} lines, else key{payload} lines; others go."""
    v = F.col(value)
    hashed = F.regexp_extract(v, _HASHED, 2)
    fields = F.element_at(F.map_entries(F.from_json(v, "map<string,variant>")), 1)
    first = F.struct(fields["key"].alias("key"), F.coalesce(F.to_json(fields["value"]), F.lit("null")).alias("value"))
    flow_key, flow = F.regexp_extract(v, r"^([^\s{}#]+)(\{.*\})\s*$", 1), F.regexp_extract(v, r"^([^\s{}#]+)(\{.*\})\s*$", 2)
    is_map = F.try_parse_json(v).isNotNull() & v.startswith("{")
    key = F.when(hashed != "", hashed).when(is_map, first["key"]).when(flow_key != "", flow_key)
    payload = F.when(hashed != "", F.regexp_extract(v, _HASHED, 1)).when(is_map, first["value"]).when(flow_key != "", flow)
    return lines.withColumn("key", key).withColumn("payload", payload).where(F.col("key").isNotNull() & F.try_parse_json("payload").isNotNull())


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value) of text files, a row a line.

    Files are read in splits; a line's number is its place in its split plus the lines of the splits before it, which are
    counted first (one row a split).  So a file of any size is many tasks.
    """
    meta = F.col("_metadata")
    rows = spark.read.text(path).select(meta["file_path"].alias("path"), meta["file_block_start"].alias("at"), "value", F.monotonically_increasing_id().alias("id"))
    w = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("path", "at").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = splits.select("path", "at", "first", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return rows.join(before, ["path", "at"]).select("path", (F.col("before") + F.col("id") - F.col("first")).alias("line_no"), F.regexp_replace("value", r"\r$", "").alias("value"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(log, seq, key, payload) of log files; seq is the line's place in its file."""
    return parse_lines(numbered_lines(spark, path)).select(F.col("path").alias("log"), F.col("line_no").alias("seq"), "key", "payload")


def hashed_line(key: Column, payload: Column) -> Column:
    return F.concat(payload, F.lit("#"), key)


def jsonl_line(key: Column, payload: Column) -> Column:
    return F.concat(F.lit('{"'), key, F.lit('":'), payload, F.lit("}"))


def flow_line(key: Column, payload: Column) -> Column:
    return F.concat(key, payload)


LINES = {"dash": hashed_line, "jsonl": jsonl_line, "flow": flow_line}


def write_log(log: DataFrame, path: str, kind: str = "dash", mode: str = "append") -> None:
    """One text file a log, in order."""
    rows = log.repartition("log").sortWithinPartitions("log", "seq").select("log", LINES[kind](F.col("key"), F.col("payload")).alias("value"))
    rows.write.mode(mode).partitionBy("log").text(path)


def parse_env(text: Column) -> Column:
    """KEY=VALUE lines as a map: blanks and # lines are skipped, split at the first =, matching quotes are stripped, last wins."""
    rows = F.filter(F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#") & x.contains("="))
    pairs = F.transform(rows, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^=]*=", "")), r"^(['\"])(.*)\1$", "$2").alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def read_env(spark: SparkSession, path: str) -> DataFrame:
    """(path, env); a file whose name begins with a dot, which Spark's readers pass over, is read on the driver."""
    if os.path.basename(path).startswith(".") and os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            whole = spark.createDataFrame([(path, f.read())], "path string, value string")
    else:
        whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return whole.select("path", parse_env(F.col("value")).alias("env"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line)"""
    return numbered_lines(spark, path).withColumnRenamed("value", "line")


def read_blob(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def list_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length); contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc): a JSON or YAML file as a variant."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    if path.rsplit(".", 1)[-1] in ("yaml", "yml"):

        @F.pandas_udf("string")
        def to_json(texts: pd.Series) -> pd.Series:
            import json

            from .stores import parse_mini_yaml

            try:
                from yaml import safe_load
            except ImportError:  # the subset that this library parses itself
                safe_load = parse_mini_yaml
            return texts.map(lambda t: json.dumps(safe_load(t or "") or {}, default=str))

        whole = whole.select("path", to_json("value").alias("value"))
    return whole.select("path", F.coalesce(F.try_parse_json("value"), F.parse_json(F.lit("{}"))).alias("doc"))
