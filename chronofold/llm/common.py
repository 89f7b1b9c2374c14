"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: UTF-8 bytes of a text to lower-cased words parted by spaces: digits, a-z and every byte of a
#: non-ASCII character are word bytes, A-Z become a-z, all else becomes a space.
WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this library even if only the driver's sys.path has it."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m") in ("64m", "67108864", "67108864b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")  # whole texts: keep a batch small
    if spark.conf.get("spark.sql.objectHashAggregate.sortBased.fallbackThreshold") == "128":
        spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")  # lists of a few hundred longs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a local one only where it names none and all runs in
    one process.  On a cluster without one this raises: a machine's own folder would not be shared."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="chronofold-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, and
    gives the planner a file size by which it may choose a broadcast."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has no more than the given number of (narrow) rows; df is cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(text: str) -> list[bytes]:
    """The lower-cased words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (in place on a fresh array)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def text_pieces(text: str, size: int):
    """A text in pieces of about size code points, cut only at a space or line end (which is left out)."""
    at, n = 0, len(text)
    while n - at > size:
        cut = min((x for x in (text.find(" ", at + size), text.find("\n", at + size)) if x >= 0), default=-1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def groups_of_texts(texts, size: int = 1 << 20):
    """Consecutive texts in groups of about size code points: [(index, piece)], long texts in several pieces."""
    group, n = [], 0
    for i, t in enumerate(texts):
        for piece in text_pieces(t or "", size):
            group.append((i, piece))
            n += len(piece)
            if n >= size:
                yield group
                group, n = [], 0
    if group:
        yield group
