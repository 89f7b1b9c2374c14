"""Suffix-array dedup: every 400-byte string that starts twice, by bucket-pointer refinement.

A suffix array of the whole corpus is not kept; what counts is which suffixes are equal in their first 400
bytes.  As in bucket-pointer refinement, suffixes are first put into buckets by a q-gram (here q = 200) and the
buckets are refined by the bucket identifiers of later offsets (here at +200, which gives 400 bytes at once);
identifiers made for one suffix serve all that read them.

* Only one suffix in about a hundred needs a bucket of its own: each 400-byte string is led by its *anchor*, the
  least 200-gram (by hash, leftmost of equals) of the 201 that it holds.  Equal strings have equal anchors at equal
  offsets, so they meet in the anchor's bucket.  An anchor leads a run of consecutive strings.
* Runs with equal text (and equal offsets) in a bucket settle each other: all their strings are repeated.  A bucket
  with one kind of run needs no more work; a bucket with one run has no repeat.
* In other buckets one run of each kind is refined string by string: in buckets of at most SMALL kinds on the
  runs' bytes, sorted by the two bucket identifiers; in larger ones (a passage in very many surroundings) by a
  pre-aggregated count over the strings' hashes, so no task gathers a large bucket.

Texts of at least 400 bytes that occur twice go whole; they still lead others' strings to their bucket.
Buckets are compared by 64-bit hashes, kinds and strings by 128 bits.

Plan: two narrow passes find the anchors; the first counts their buckets (8 bytes an anchor are shuffled), the second
keeps those in a bucket that occurs twice, which is written down.  All else works on these.  The texts are shuffled
once, for the refinement and the removal (the exchange is reused).  The table of repeated buckets is broadcast
only if it has no more than BUCKETS rows.

Passages.  400 bytes can be more than a passage of 51 words has, so ``n_passages`` tells of these: of each 51 words in a row
the least (by hash) of their twelve 40-word strings is a mark, and n_passages is the number of a document's different
marks that another row holds too.  It is above 0 wherever 51 words in a row also occur in another row, and it is 0 where no
40 words do; nothing is removed for it.  Two narrow passes and one count of marks (8 bytes each), as for the anchors.

Edge cases.  Null text: empty.  Texts under 400 bytes, empty tables: nothing goes.  Repeated rows: both go.  Long
texts are read in parts.  Null ids are kept.  Other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, materialise, mix64, powers, prepare, small_side

LENGTH, Q = 400, 200
PASSAGE, MARK = 51, 40  # words
SMALL, PART, BUCKETS = 64, 1 << 20, 2_000_000
_SHIFT = np.uint64(24)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TABLES: dict = {}


class Rolling:
    """Hashes of any range of a buffer, from running sums modulo 2^64."""

    def __init__(self, data: np.ndarray, base: int):
        n = len(data)
        key = (base, "powers")
        if key not in _TABLES or len(_TABLES[key][0]) < n + 1:
            size = max(n + 1, PART + 4096)
            _TABLES[key] = (powers(base, size), powers(pow(base, -1, 1 << 64), size), mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(base)))
        forth, self.back, codes = _TABLES[key]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes[data] * forth[:n], out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        """Of every range of that size, by its start."""
        n = len(self.sums) - size
        return mix64((self.sums[size:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def parts_of(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) in groups of about PART bytes; parts of a text overlap so that each string is in one."""
    group, n = [], 0
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        for at in range(0, len(t) - LENGTH + 1, PART):
            piece = t[at : at + PART + LENGTH - 1]
            group.append((i, at, piece))
            n += len(piece)
            if n >= PART:
                yield group
                group, n = [], 0
    if group:
        yield group


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, bucket, kind, first string, strings less one, anchor less first string) of each run."""
    for group in parts_of(texts):
        data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
        sizes = np.array([len(p) for _, _, p in group])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        h = Rolling(data, _BASES[0])
        grams = h.all(Q)
        ranked = (grams >> _SHIFT) << _SHIFT
        ranked |= np.arange(len(grams), dtype=np.uint64)  # of equals the leftmost
        lead = (sliding_min(ranked, LENGTH - Q + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        valid = np.zeros(len(data) + 1, np.int8)
        np.add.at(valid, begins, 1)
        np.add.at(valid, ends - LENGTH + 1, -1)
        p = np.flatnonzero(np.cumsum(valid[:-1]))
        own = np.searchsorted(ends, p, side="right")
        a = lead[p]
        new = np.ones(len(p), bool)
        new[1:] = (a[1:] != a[:-1]) | (own[1:] != own[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(p)) - 1
        lo, hi, at, own = p[first], p[last], a[first], own[first]
        kind = Rolling(data, _BASES[1]).at(lo, hi + LENGTH)
        kind = mix64(kind ^ ((at - lo) * 1000 + (hi - lo)).astype(np.uint64))
        text, offset = np.array([i for i, _, _ in group])[own], np.array([o for _, o, _ in group])[own]
        yield text, grams[at].view(np.int64), kind.view(np.int64), lo - begins[own] + offset, hi - lo, at - lo


def word_parts(texts: list[bytes], part: int = PART) -> Iterator[list[tuple[int, bytes]]]:
    """(text, lower-cased words parted by spaces) in groups of about part bytes; parts of a text share PASSAGE - 1 words."""
    group, n = [], 0
    for i, t in enumerate(texts):
        line, at = t.translate(WORD_BYTES), 0
        while True:
            end = line.find(b" ", at + part)
            piece = line[at:] if end < 0 else line[at:end]
            group.append((i, piece))
            n += len(piece)
            if n >= part:
                yield group
                group, n = [], 0
            if end < 0:
                break
            held = piece.rsplit(None, PASSAGE - 1)
            if len(held) == PASSAGE and held[0]:
                at += len(held[0])
            else:  # fewer words than that in so many bytes: take in more of them
                at, part = at, part * 2
    if group:
        yield group


def marks(texts: list[bytes], part: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, mark): each text's different marks (of a part of it, where it has several)."""
    for group in word_parts(texts, part):
        data = np.frombuffer(b" ".join([*(p for _, p in group), b""]), np.uint8)
        ends = np.cumsum([len(p) + 1 for _, p in group])
        word = np.zeros(len(data) + 2, np.int8)
        word[1:-1] = data != 32
        edge = np.diff(word)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(start) < PASSAGE:
            continue
        w = Rolling(data, _BASES[0]).at(start, stop)
        own = np.searchsorted(ends, start, side="right")
        forth, back, _ = _TABLES[(_BASES[0], "powers")]
        sums = np.zeros(len(w) + 1, np.uint64)
        np.cumsum(w * forth[: len(w)], out=sums[1:])
        n = len(w) - MARK + 1
        grams = mix64((sums[MARK:] - sums[:n]) * back[:n])
        least = sliding_min(grams, PASSAGE - MARK + 1)
        whole = own[: len(least)] == own[PASSAGE - 1 :]
        at, least = np.array([i for i, _ in group])[own[: len(least)][whole]], least[whole]
        order = np.lexsort((least, at))
        at, least = at[order], least[order]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (least[1:] != least[:-1])
        yield at[new], least[new]


def _mark_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, uid, key = (batch.column(c).to_numpy() for c in ("row", "uid", "key"))
        for text, mark in marks(_bytes(batch.column("text").to_pylist())):
            yield pa.RecordBatch.from_arrays([pa.array(row[text]), pa.array(uid[text]), pa.array(key[text]), pa.array(mark.view(np.int64))], names=["row", "uid", "key", "m"])


def shared_passages(base: DataFrame) -> DataFrame:
    """(uid, key, n_passages) of the texts with marks that another row holds; base: (uid, key, text)."""
    rows = base.select(F.monotonically_increasing_id().alias("row"), "uid", "key", "text").mapInArrow(_mark_rows, "row long, uid long, key long, m long")
    # A text in several parts may tell a mark twice: a mark's rows are counted, not its tellings.
    held = rows.groupBy("m").agg(F.min("row").alias("a"), F.max("row").alias("b"))
    again = materialise(held.where("a <> b").select("m"), "suffix-marks")
    return rows.join(small_side(again, BUCKETS), "m", "left_semi").groupBy("uid", "key").agg(F.count_distinct("m").alias("n_passages"))


def refine(contexts: list[bytes], weights: np.ndarray) -> list[list[tuple[int, int]]]:
    """Ranges [first, end) of each context's strings that occur twice among all of them (by weight)."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    begins = np.cumsum(sizes) - sizes
    strings = sizes - LENGTH + 1
    own = np.repeat(np.arange(len(contexts)), strings)
    p = begins[own] + np.arange(len(own)) - (np.cumsum(strings) - strings)[own]
    # Bucket identifiers of the 200-grams at each string's start and 200 bytes later, one numbering for both.
    grams = Rolling(data, _BASES[0]).all(Q)
    both = np.concatenate((p, p + LENGTH - Q))
    ids = np.unique(grams[both], return_inverse=True)[1]
    pair = ids[: len(p)].astype(np.int64) * (len(both) + 1) + ids[len(p) :]
    bucket = np.unique(pair, return_inverse=True)[1]
    repeated = np.bincount(bucket, weights=weights[own])[bucket] >= 2
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], repeated.view(np.int8), [0]))))
    for s, e in edge.reshape(-1, 2):  # a range may span contexts
        while s < e:
            k = own[s]
            stop = min(e, int(np.searchsorted(own, k, side="right")))
            out[k].append((int(p[s] - begins[k]), int(p[stop - 1] - begins[k]) + 1))
            s = stop
    return out


def _pack(first, more, lead):
    return (first << 20) | (more << 10) | lead


def _bytes(values) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in values]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        uid, key = batch.column("uid").to_numpy(), batch.column("key").to_numpy()
        for text, h, f, first, more, lead in anchors(_bytes(batch.column("text").to_pylist())):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (uid[text], key[text], h, f, _pack(first, more, lead))], names=["uid", "key", "h", "f", "run"])


_CONTEXT = "h long, uid long, key long, first long, cnt long, context binary"
_STRINGS = "k1 long, k2 long, uid long, key long, at long, cnt long"
_RANGES = "uid long, key long, s long, e long"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for uid, key, text, runs in zip(batch.column("uid").to_pylist(), batch.column("key").to_pylist(), batch.column("text"), batch.column("runs").to_pylist(), strict=True):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            rows += [(r["h"], uid, key, r["run"] >> 20, r["cnt"], data[r["run"] >> 20 : (r["run"] >> 20) + (r["run"] >> 10 & 1023) + LENGTH]) for r in runs]
        if rows:
            kinds = (*[pa.int64()] * 5, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["h", "uid", "key", "first", "cnt", "context"])


def _string_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _contexts(batches):
        first, uid, key, cnt = (batch.column(c).to_numpy() for c in ("first", "uid", "key", "cnt"))
        contexts = batch.column("context").to_pylist()
        for a in range(0, len(contexts), 1000):
            part = contexts[a : a + 1000]
            data = np.frombuffer(b"".join(part), np.uint8)
            sizes = np.array([len(c) for c in part])
            begins, strings = np.cumsum(sizes) - sizes, sizes - LENGTH + 1
            own = np.repeat(np.arange(len(part)), strings)
            within = np.arange(len(own)) - (np.cumsum(strings) - strings)[own]
            k1, k2 = (Rolling(data, b).all(LENGTH)[begins[own] + within].view(np.int64) for b in _BASES)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, uid[a:][own], key[a:][own], first[a:][own] + within, cnt[a:][own])], names=["k1", "k2", "uid", "key", "at", "cnt"])


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by bucket to ranges; several whole buckets at a time."""
    held: list[tuple] = []
    size = 0

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        found = refine([r[5] for r in rows], np.array([r[4] for r in rows]))
        out = [(r[1], r[2], r[3] + s, r[3] + e - 1 + LENGTH) for r, ranges in zip(rows, found, strict=True) for s, e in ranges]
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["uid", "key", "s", "e"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("h", "uid", "key", "first", "cnt", "context")), strict=True):
            if size > PART and held[-1][0] != row[0]:
                yield flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[5])
    if held:
        yield flush(held)


def remove(data: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(kept bytes, bytes removed, maximal removed runs)"""
    kept, at, gone, spans = [], 0, 0, 0
    end = -1
    for s, e in sorted(ranges):
        if s > end:
            spans += 1
            kept.append(data[max(end, 0) : s])
            at, end = s, e
            gone += e - s
        elif e > end:
            gone += e - end
            end = e
    kept.append(data[max(end, 0) :])
    return b"".join(kept), gone, spans


def dedup_substrings(docs: DataFrame, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages and, if asked for, kept (binary), per row of docs.

    Each byte covered by a 400-byte string that also starts anywhere else, the same text included, is removed.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    # uid: a hash of the text; key: the id, null ids lowest.
    base = docs.select("doc_id", F.xxhash64(text, F.lit(21)).alias("uid"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("key"), text.alias("text"))
    runs = base.select("uid", "key", "text").mapInArrow(_anchor_rows, "uid long, key long, h long, f long, run long")
    buckets = materialise(runs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("h"), "suffix-buckets")
    runs = materialise(runs.join(small_side(buckets, BUCKETS), "h", "left_semi"), "suffix-runs")
    copies = materialise(base.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("uid"), "suffix-copies")

    kinds = runs.groupBy("h", "f").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct("uid", "key", "run")).alias("one"))
    mixed = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > 1)
    open_ = kinds.join(mixed, "h").select("h", "cnt", "one.uid", "one.key", "one.run", (F.col("kinds") > SMALL).alias("large"))
    lists = materialise(open_.groupBy("uid", "key", "large").agg(F.collect_list(F.struct("h", "run", "cnt")).alias("runs")), "suffix-open")
    first, more = F.shiftright("run", 20), F.shiftright("run", 10).bitwiseAND(F.lit(1023))
    settled = runs.join(copies, "uid", "left_anti").join(kinds.where(F.col("cnt") > 1).select("h", "f"), ["h", "f"], "left_semi")
    ranges = settled.select("uid", "key", first.alias("s"), (first + more + LENGTH).alias("e"))

    texts = base.select("uid", "key", "doc_id", "text")
    opened = lambda large: texts.join(lists.where(F.col("large") == large).drop("large"), ["uid", "key"])
    small = opened(False).mapInArrow(_contexts, _CONTEXT).repartition("h").sortWithinPartitions("h").mapInArrow(_refined, _RANGES)
    strings = opened(True).mapInArrow(_string_rows, _STRINGS)
    again = strings.groupBy("k1", "k2").agg(F.sum("cnt").alias("n")).where(F.col("n") > 1).select("k1", "k2")
    large = strings.join(again, ["k1", "k2"], "left_semi").select("uid", "key", F.col("at").alias("s"), (F.col("at") + LENGTH).alias("e"))
    # A range of no end: the whole text goes.
    whole = base.select("uid", "key").join(copies, "uid").select("uid", "key", F.lit(0).cast("long").alias("s"), F.lit(-1).cast("long").alias("e"))
    found = ranges.unionByName(small).unionByName(large).unionByName(whole).groupBy("uid", "key").agg(F.collect_set(F.struct("s", "e")).alias("ranges"))
    found = found.join(shared_passages(base), ["uid", "key"], "full")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", *(["kept"] if with_kept else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, own, passages in zip(_bytes(batch.column("text").to_pylist()), batch.column("ranges").to_pylist(), batch.column("n_passages").to_pylist(), strict=True):
                gone = [(r["s"], r["e"]) for r in own or []]
                if any(e < 0 for _, e in gone):
                    gone = [(0, len(data))] if len(data) >= LENGTH else []
                kept, n, spans = remove(data, gone)
                rows.append((len(data), n, spans, hashlib.sha256(kept).hexdigest(), passages or 0, *([kept] if with_kept else [])))
            kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds_))], names=names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return texts.join(found, ["uid", "key"], "left").select("doc_id", "text", "ranges", "n_passages").mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long" + ", kept binary" * with_kept)


def digest(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages")
