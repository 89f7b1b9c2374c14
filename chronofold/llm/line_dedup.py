"""Line dedup [native]: levelled sorted runs of line hashes, compacted periodically, merge-anti-joined.

A line's key is the line with white space ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z
lower-cased; it is held as two 64-bit hashes.  A *run* is a table of (h1, h2, n_docs, last_doc), one
row per key, sorted by hash.  Each batch of documents adds a run to level 0; when a level holds
``fanout`` runs, they are merged into one run of the next level.  The runs of all levels together hold
each key's number of documents and its largest document id.

Two ways to use them:

* :class:`LineRuns` takes batch after batch: lines whose key the runs know already go, the batch's own
  repeats keep one holder, and the batch's keys become a new run.
* :func:`dedup_lines` takes a whole table: its batches' runs are written in one pass, compacted, and
  the lines are anti-joined with the keys held by at least ``min_docs`` documents.

Only DataFrame functions are used.  Shuffles: line hashes (not lines) twice, the texts once.  A key
that a third of the documents hold is pre-aggregated before its shuffle, and the join's partitions are
split by adaptive execution.

Edge cases.  A null or empty text is one empty line.  Rows with a null doc_id together count as one
document, smaller than all others.  Repeated rows of the same doc_id are one document to the counts and
keep a row each.  Extra columns are kept by :func:`dedup_lines` with ``keep_columns``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, prepare, shared_dir

MIN_CHARS, MIN_DOCS, FANOUT = 20, 3, 4
_BLANK = " \t\n\x0b\x0c\r"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(_BLANK)))


def _row_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit(7))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row_hash, pos, h1, h2) of every line whose key is long enough."""
    lines = docs.select(F.col("doc_id").alias("doc_id"), _row_hash(F.col("text")).alias("row_hash"), F.posexplode(F.transform(split_lines(F.col("text")), line_key)).alias("pos", "k"))
    return lines.where(F.char_length("k") >= min_chars).select("doc_id", "row_hash", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"))


def make_run(hashes: DataFrame, *by: str) -> DataFrame:
    """(h1, h2, n_docs, last_doc): distinct documents by key and the largest of their ids."""
    return hashes.groupBy(*by, "h1", "h2").agg(F.count_distinct(F.struct("doc_id")).alias("n_docs"), F.max("doc_id").alias("last_doc"))


def merge_runs(runs: DataFrame) -> DataFrame:
    """Runs of disjoint documents as one."""
    return runs.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))


class LineRuns:
    """The levelled runs, as tables in a shared folder."""

    def __init__(self, spark, path: str | None = None, fanout: int = FANOUT):
        prepare(spark)
        self.spark, self.fanout = spark, fanout
        self.path = path or f"{shared_dir(spark)}/line-runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [self.spark.read.parquet(p) for level in self.levels for p in level]

    def known(self) -> DataFrame | None:
        """All runs merged."""
        runs = self.runs()
        if not runs:
            return None
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return merge_runs(out) if len(runs) > 1 else out

    def add_run(self, run: DataFrame, sort: bool = True) -> None:
        path = f"{self.path}/{uuid.uuid4().hex}"
        (run.sortWithinPartitions("h1", "h2") if sort else run).write.option("compression", "zstd").parquet(path)
        self.adopt(path)

    def adopt(self, *paths: str) -> None:
        """Tables written elsewhere become runs of level 0; full levels are compacted."""
        self.levels[0] += paths
        k = 0
        while k < len(self.levels):
            if len(self.levels[k]) >= self.fanout:
                merged = f"{self.path}/{uuid.uuid4().hex}"
                merge_runs(self.spark.read.parquet(*self.levels[k])).sortWithinPartitions("h1", "h2").write.option("compression", "zstd").parquet(merged)
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(merged)
            k += 1

    def ingest(self, batch: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
        """The batch without the lines that the runs know and without its own repeats (the largest doc_id
        holding a line keeps it); the batch's keys are added as a run of level 0."""
        batch = materialise(batch.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")), "line-batch")
        own = make_run(line_hashes(batch, min_chars))
        known = self.known()
        if known is not None:
            own = own.join(known.select("h1", "h2", F.lit(True).alias("old")), ["h1", "h2"], "left")
        else:
            own = own.withColumn("old", F.lit(None).cast("boolean"))
        own = materialise(own, "line-own")
        gone = own.where(F.col("old") | (F.col("n_docs") > 1)).withColumn("last_doc", F.when(F.col("old"), F.lit(None)).otherwise(F.col("last_doc")))
        out = materialise(_drop(batch, gone, min_chars, keep_null_last=False), "line-kept")
        self.add_run(own.drop("old"))
        return out


def _drop(docs: DataFrame, gone: DataFrame, min_chars: int, keep_null_last: bool = True) -> DataFrame:
    """docs with lines (kept, joined), n_lines and n_dropped; gone: keys that only last_doc keeps."""
    hashes = line_hashes(docs, min_chars)
    same = F.col("doc_id").eqNullSafe(F.col("last_doc")) if keep_null_last else F.coalesce(F.col("doc_id") == F.col("last_doc"), F.lit(False))
    hit = hashes.join(gone.select("h1", "h2", "last_doc"), ["h1", "h2"]).where(~same)
    dropped = hit.groupBy("doc_id", "row_hash").agg(F.collect_set("pos").alias("dropped"))
    left, right = docs.withColumn("__row", _row_hash(F.col("text"))).alias("l"), dropped.alias("r")
    joined = left.join(right, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.__row") == F.col("r.row_hash")), "left").select("l.*", F.col("r.dropped").alias("__dropped"))
    lines = split_lines(F.col("text"))
    out = joined.withColumn("__lines", lines).withColumn("n_lines", F.size("__lines").cast("long"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__dropped"))
    kept = F.when(F.col("__dropped").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(F.transform(keep, lambda i: F.element_at("__lines", i + 1)), "\n"))
    return out.withColumn("n_dropped", F.coalesce(F.size("__dropped").cast("long"), F.lit(0).cast("long"))).withColumn("text", kept).drop("__lines", "__dropped", "__row")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = FANOUT, keep_columns: bool = False) -> DataFrame:
    """doc_id, text (kept lines joined by \\n), n_lines (before dropping), n_dropped, one row per row of docs.

    Keys of at least min_chars code points in at least min_docs documents lose all their lines except in
    the largest doc_id holding them.
    """
    spark = docs.sparkSession
    prepare(spark)
    clash = {"n_lines", "n_dropped", "__row", "__lines", "__dropped"}
    docs = docs.select([c for c in docs.columns if c.lower() not in clash]) if keep_columns else docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    store = LineRuns(spark, fanout=batches)
    hashes = line_hashes(docs.select("doc_id", "text"), min_chars)
    run = make_run(hashes.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "batch")
    path = f"{store.path}/first"
    run.sortWithinPartitions("batch", "h1", "h2").write.option("compression", "zstd").partitionBy("batch").parquet(path)
    written = spark.read.schema(run.schema).parquet(path)
    # One job wrote the runs of all batches; merging them is the compaction of a full level 0.
    merged = merge_runs(written).where(F.col("n_docs") >= min_docs).sortWithinPartitions("h1", "h2")
    return _drop(docs, materialise(merged, "line-level1"), min_chars)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = """
WITH line AS (
  SELECT doc_id, i, l, translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
many AS (SELECT k, max(doc_id) AS last_doc FROM line WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT line.doc_id, i, l, many.k IS NOT NULL AND line.doc_id <> last_doc AS gone FROM line LEFT JOIN many ON line.k = many.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
