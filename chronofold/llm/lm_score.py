"""LM scoring: compression cross-entropy under an in-domain and a general dictionary.

The in-domain corpus is the documents labelled of good quality, the general one all documents.  The words of both (runs
of characters that are not blank; longer ones in pieces of MAX_CHARS) are counted over the whole corpus by a native
aggregation; the words that save the most bytes make each dictionary, the most useful last, where zstandard reaches
them cheapest.  A dictionary grows with the square root of the corpus (ROOT_BYTES a root of a byte: 0.1 MB for 0.17 GB of
text, 2 MB for 50 GB, 80 MB for 100 TB), so that it learns more from more text and still fits a worker.

A text's score is (g - d) / max(g, d), g and d being its zstandard sizes under the general and the in-domain
dictionary: above 0 if it is more like the in-domain corpus.

Plan: the ids of good documents are broadcast if they are no more than GOOD_ROWS, else joined.  The least saving that a
dictionary takes is read from a histogram of savings (some hundred rows), so the driver gets its words and no others.

Edge cases.  Null or empty text: sizes of an empty frame, score 0.  Words of under MIN_CHARS characters are not counted: no
match of zstandard is as short.  Without labels of good quality the in-domain dictionary is empty.  Repeated documents: a row each,
and each counts in the corpus.  A document with several labels is in-domain if any is good.  Null ids are kept and are
never in-domain.  Empty table: no rows.  Other columns are dropped.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, prepare, small_side

ROOT_BYTES, LEVEL = 8, 3
MIN_CHARS, MAX_CHARS, GOOD_ROWS, STEPS = 3, 48, 2_000_000, 16
_COMPRESSORS: dict = {}


def dictionary_bytes(corpus: int, root_bytes: int = ROOT_BYTES) -> int:
    return root_bytes * math.isqrt(max(0, corpus))


def word_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(word, n_all, n_good): occurrences over all documents and over those of good quality."""
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("good_id")).distinct()
    d = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).join(small_side(good, GOOD_ROWS), F.col("doc_id") == F.col("good_id"), "left")
    pieces = F.regexp_extract_all("text", F.lit(f"[^ \\n]{{1,{MAX_CHARS}}}"), F.lit(0))
    w = d.select(F.when(F.col("good_id").isNotNull(), 1).otherwise(0).alias("good"), F.explode(pieces).alias("word"))
    w = w.where(F.char_length("word") >= MIN_CHARS)
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n_all"), F.sum("good").alias("n_good"))


def dictionary(counts: DataFrame, column: str, size: int) -> bytes:
    """The words that save most under a count, as raw dictionary content of at most size bytes.

    Words are taken by whole steps of the logarithm of what they save (STEPS to a doubling), down to the last step that fits.
    """
    saving = (F.col(column) - 1) * F.octet_length("word")
    own = counts.where(F.col(column) > 1).select("word", saving.alias("saving"), F.floor(F.log2(saving) * STEPS).alias("step"))
    left, least = size, None
    for step, n in own.groupBy("step").agg(F.sum(F.octet_length("word") + 1).alias("bytes")).orderBy(F.desc("step")).collect():
        left -= n
        if left < 0:
            break
        least = step
    if least is None:
        return b""
    rows = own.where(F.col("step") >= least).select("word", "saving").collect()
    return b"".join(r["word"].encode("utf-8", "surrogatepass") + b" " for r in sorted(rows, key=lambda r: (r["saving"], r["word"])))


def _compressors(key: str, contents: tuple[bytes, bytes], level: int):
    if key not in _COMPRESSORS:
        import zstandard as z

        _COMPRESSORS.clear()
        made = []
        for content in contents:
            params = z.ZstdCompressionParameters.from_level(level, window_log=max(21, len(content).bit_length() + 1), write_checksum=0, write_content_size=0, write_dict_id=0)
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
            made.append(z.ZstdCompressor(dict_data=d, compression_params=params) if d else z.ZstdCompressor(compression_params=params))
        _COMPRESSORS[key] = made
    return _COMPRESSORS[key]


def score_text(compressors, text: str | None) -> tuple[int, int, float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    d, g = (len(c.compress(data)) for c in compressors)
    return d, g, (g - d) / max(g, d)


def lm_score(docs: DataFrame, labels: DataFrame, root_bytes: int = ROOT_BYTES, level: int = LEVEL) -> DataFrame:
    """doc_id, in_domain_bytes, general_bytes, score per row of docs."""
    spark = docs.sparkSession
    prepare(spark)
    counts = materialise(word_counts(docs, labels).where(F.col("n_all") > 1), "lm-words")
    # Bytes of words that occur twice or more stand for the size of the corpus: both grow alike.
    size = dictionary_bytes(counts.agg(F.sum(F.col("n_all") * F.octet_length("word"))).first()[0] or 0, root_bytes)
    held = spark.sparkContext.broadcast((dictionary(counts, "n_good", size), dictionary(counts, "n_all", size)))
    key = uuid.uuid4().hex
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("in_domain_bytes", T.LongType()), T.StructField("general_bytes", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _compressors(key, held.value, level)
            rows = [score_text(made, t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64())))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)
