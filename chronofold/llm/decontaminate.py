"""Benchmark decontamination: one Aho-Corasick automaton over the windows of normalised test items.

Each text is normalised (A-Z lower-cased, words of digits, a-z and non-ASCII characters), its words are
numbered by those of the items, and it is scanned once by the automaton; matches are ranges of words, mapped
back to code-point offsets of the original text.  Two words in a row that are so in no item end every window, so the
automaton is only fed the runs between such places that are as long as the shortest window.

Plan: one narrow pass over the documents (no shuffle).  The items are broadcast in blocks of at most
``block_bytes`` (about 100 bytes of automaton a byte), so what a worker holds is bounded whatever the size of
the benchmark: one automaton up to 4 MB of items; each further block is one more narrow pass that adds its matches to those found before.

Edge cases.  Null or word-less text: no words, not contaminated.  Null or word-less item: no window.
An item with a null id marks words but is not listed.  Repeated documents are rows of their own;
repeated items count once by id.  Empty benchmark: nothing is hit.  Input columns named like an
output column are replaced, all others are kept.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, words

WINDOW, RATIO = 13, 20
_SPOT = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_AUTOMATA: dict = {}


class Windows:
    """The automaton over word numbers, the numbers of the words that items hold (0: any other word), the sorted pairs of
    words in a row that windows hold, as one number each, and the words of the shortest window."""

    def __init__(self, numbers: dict[bytes, int], automaton, windows):
        self.numbers, self.automaton = numbers, automaton
        self.base, self.least = len(numbers) + 1, min(map(len, windows))
        self.pairs = np.array(sorted({a * self.base + b for w in windows for a, b in zip(w, w[1:])}), np.int64)

    def runs(self, ws: list[bytes]) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(first word, word numbers) of the runs that may hold a window; no window lies outside them or across two."""
        x = np.fromiter(map(self.numbers.get, ws, repeat(0)), np.int64, len(ws))
        known = np.concatenate(([False], x > 0, [False]))
        joined = np.zeros(len(x) + 1, bool)  # whether a word goes on from the one before
        at = np.flatnonzero(known[1:-2] & known[2:-1])
        if len(at) and len(self.pairs):
            pair = x[at] * self.base + x[at + 1]
            joined[at + 1] = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
        start = np.flatnonzero(known[1:-1] & ~joined[:-1])
        stop = np.flatnonzero(known[1:-1] & ~joined[1:]) + 1
        long = stop - start >= self.least
        for a, b in zip(start[long].tolist(), stop[long].tolist(), strict=True):
            yield a, tuple(x[a:b].tolist())


def build_automaton(items: list[tuple[str | None, str | None]], window: int) -> Windows | None:
    """Windows of every item as sequences of word numbers -> (number of words, item ids); None if there is none.

    A window is as many steps as it has words, not letters, which bounds the automaton at window nodes a word.
    """
    numbers: dict[bytes, int] = {}
    found: dict[tuple[int, ...], tuple[int, set]] = {}
    for item_id, text in items:
        ws = [numbers.setdefault(w, len(numbers) + 1) for w in words(text or "")]
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            found.setdefault(tuple(ws[i : i + n]), (n, set()))[1].update([] if item_id is None else [item_id])
    if not found:
        return None
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, value in found.items():
        automaton.add_word(key, value)
    automaton.make_automaton()
    return Windows(numbers, automaton, found)


def _automaton(key: str, items: list, window: int):
    if key not in _AUTOMATA:
        while len(_AUTOMATA) > 1:
            _AUTOMATA.pop(next(iter(_AUTOMATA)))
        _AUTOMATA[key] = build_automaton(items, window)
    return _AUTOMATA[key]


def scan(automaton, text: str) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words; merged ranges [first, end) of hit words; items with an occurring window."""
    ws = words(text)
    if automaton is None or not ws:
        return len(ws), [], set()
    hits, items = [], set()
    for first, run in automaton.runs(ws):
        for last, (n, ids) in automaton.automaton.iter(run):
            hits.append((first + last + 1 - n, first + last + 1))
            items |= ids
    return len(ws), merge(hits), items


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def original_offsets(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point ranges of the original text that the ranges of words cover."""
    at = [m.span() for m in _SPOT.finditer(text)] if ranges else []
    return [(at[s][0], at[e - 1][1]) for s, e in ranges]


_RANGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_NEW = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_words", _RANGES),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_PA_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find_benchmark_words(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, with_spans: bool = False, block_bytes: int = 4 << 20) -> DataFrame:
    """The columns of docs with n_words, hit_words (ranges of words), items (sorted ids as strings) and,
    if asked for, hit_spans (code-point ranges of the original text)."""
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    new = T.StructType([*_NEW.fields, *([T.StructField("hit_spans", _RANGES)] if with_spans else [])])
    out = docs.select([c for c in docs.columns if c.lower() not in {f.name for f in new.fields}])
    for k in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        held = spark.sparkContext.broadcast([tuple(r) for r in block.collect()])
        carry = [c for c in out.columns if k == 0 or c not in {f.name for f in new.fields}]
        schema = T.StructType([*(out.schema[c] for c in carry), *new.fields])
        out = out.mapInArrow(_scanner(held, uuid.uuid4().hex, text, window, carry, with_spans), schema)
    return out


def _scanner(held, key: str, text: str, window: int, carry: list[str], with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None
        for batch in batches:
            automaton = automaton or _automaton(key, held.value, window)
            texts = batch.column(text).to_pylist()
            n = len(texts)
            before = batch.column("hit_words").to_pylist() if "hit_words" in batch.schema.names and "hit_words" not in carry else [[]] * n
            listed = batch.column("items").to_pylist() if "items" in batch.schema.names and "items" not in carry else [[]] * n
            counts, hits, items, spans = [], [], [], []
            for t, old, ids in zip(texts, before, listed, strict=True):
                count, ranges, found = scan(automaton, t or "")
                if old:
                    ranges = merge([*ranges, *((r["start"], r["end"]) for r in old)])
                counts.append(count)
                hits.append([{"start": s, "end": e} for s, e in ranges])
                items.append(sorted(found.union(ids)) if ids else sorted(found))
                if with_spans:
                    spans.append([{"start": s, "end": e} for s, e in original_offsets(t or "", ranges)])
            columns = [batch.column(c) for c in carry] + [pa.array(counts, pa.int64()), pa.array(hits, _PA_RANGES), pa.array(items, pa.list_(pa.string()))]
            names = [*carry, "n_words", "hit_words", "items"]
            if with_spans:
                columns.append(pa.array(spans, _PA_RANGES))
                names.append("hit_spans")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, ratio: int = RATIO, with_spans: bool = True) -> DataFrame:
    """find_benchmark_words with n_hit, n_items and contaminated (n_hit > 0 and ratio * n_hit >= n_words)."""
    found = find_benchmark_words(docs, benchmark, text, window, with_spans)
    hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return (
        found.withColumn("n_hit", hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (ratio * F.col("n_hit") >= F.col("n_words")))
    )


def cut(text: str, spans: str = "hit_spans") -> F.Column:
    """The text without the spans (sorted, disjoint code-point ranges)."""
    start = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate(spans, start, lambda a, r: F.struct(F.concat(a["kept"], F.substring(F.col(text), (a["at"] + 1).cast("int"), (r["start"] - a["at"]).cast("int"))).alias("kept"), r["end"].alias("at")))
    return F.concat(done["kept"], F.substring(F.col(text), (done["at"] + 1).cast("int"), F.char_length(text)))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, ratio: int = RATIO) -> DataFrame:
    """docs (doc_id, text and others) without contaminated documents and those that hold a whole window of `window` words;
    a shorter item's words, which may be met by chance, are cut out of the documents that stay.  A null text stays null."""
    names = docs.columns
    found = decontaminate(docs, benchmark, window=window, ratio=ratio)
    held = F.exists("hit_words", lambda r: r["end"] - r["start"] >= window)
    kept = found.where(~F.col("contaminated") & ~held)
    return kept.withColumn("text", F.when(F.size("hit_spans") > 0, cut("text")).otherwise(F.col("text"))).select(names)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def items_sha256(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


ORACLE = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS k, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM item WHERE len(ws) > 0)),
doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
dw AS (
  SELECT doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS win
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM iw))),
occ AS (SELECT dw.doc_id, dw.i, dw.k, iw.item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM occ) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM doc LEFT JOIN hit ON doc.doc_id = hit.doc_id LEFT JOIN its ON doc.doc_id = its.doc_id
"""
