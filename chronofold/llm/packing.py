"""Packing into sequences of at most 4096 tokens: bounded-space online best fit.

Each partition keeps ``windows`` open windows.  A document's full 4096-token chunks are sequences of their
own; its rest goes into the open window that it fits most tightly.  When it fits none, it tops up the
fullest window, which is emitted without a gap, and what is left of it opens a new window.  At the end of
the partition the open windows are merged, cutting freely, and the last partial sequence is cut at powers of
two, which need no padding.  So a document is cut rarely and no sequence has padding.

Plan: one narrow pass, no shuffle; a worker holds ``windows`` x 4096 ids, one batch of texts and a bounded
cache of words.  Sequence ids are the partition's number and a count within it.

Tokens: distinct blank-separated chunks are encoded once per worker and looked up after that.  Plain words
(letters, perhaps one punctuation mark behind) are merged by tiktoken over the same vocabulary, word ends
being marked by a byte that no such word holds; every other chunk goes through tokenizers itself.  Tests hold
the ids equal to those of tokenizers for whole texts.

Edge cases.  Null text: empty, that is the end id alone.  Repeated documents are packed each.  Null ids are
kept.  Empty table: no rows.  Other columns are dropped.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import groups_of_texts, prepare

LENGTH, END_ID, WINDOWS, CACHE = 4096, 2, 32, 500_000
_MARK = "\x01"
_TOKENIZERS: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_of_char() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of texts by a word-end BPE vocabulary, equal to tokenizers' with add_special_tokens=False."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.exact, self.cache = Tokenizer.from_file(path), cache
        vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        byte_of = _byte_of_char()
        ranks: dict[bytes, int] = {}
        self.is_end = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            end = token.endswith("</w>")
            chars = token[:-4] if end else token
            if all(c in byte_of for c in chars) and not (end and _MARK.encode() in bytes(byte_of[c] for c in chars)) and not (token.startswith("<|") and token.endswith("|>")):
                ranks[bytes(byte_of[c] for c in chars) + _MARK.encode() * end] = i
                self.is_end[i] = end
        self.fast = tiktoken.Encoding("word-ends", pat_str="[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.start, self.size, self.ids = array("q"), array("q"), array("I")
        self._views = None

    @staticmethod
    def plain(chunk: str) -> str | None:
        """The chunk's lower-cased pre-tokens, each with a mark behind, if it is a plain word."""
        if chunk.isascii() and chunk.isalpha():
            return chunk.lower() + _MARK
        word, tail = (chunk[:-1], chunk[-1]) if len(chunk) > 1 and chunk[-1] in ".,;:!?" else (chunk, "")
        if not word.isalpha() or not word.isascii() and ("Σ" in word or not unicodedata.is_normalized("NFC", word) or not word.lower().isalpha()):
            return None
        return word.lower() + _MARK + (tail + _MARK if tail else "")

    def learn(self, chunks: list[str]) -> None:
        marked, counts, plain, other = [], [], [], []
        for chunk in chunks:
            if p := self.plain(chunk):
                marked.append(p)
                counts.append(p.count(_MARK))
                plain.append(chunk)
            else:
                other.append(chunk)
        for chunk, found in zip(other, self.exact.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self._add(chunk, found.ids)
        if not plain:
            return
        ids = np.array(self.fast.encode_ordinary("".join(marked)), np.uint32)
        ends = np.flatnonzero(self.is_end[ids]) + 1
        last = ends[np.cumsum(counts) - 1]
        at = len(self.ids)
        first = np.concatenate(([0], last[:-1]))
        self.ids.frombytes(ids.tobytes())
        self.start.frombytes((first + at).astype(np.int64).tobytes())
        self.size.frombytes((last - first).astype(np.int64).tobytes())
        n = len(self.index)
        self.index.update(zip(plain, range(n, n + len(plain)), strict=True))

    def _add(self, chunk: str, ids: list[int]) -> None:
        self.index[chunk] = len(self.index)
        self.start.append(len(self.ids))
        self.size.append(len(ids))
        self.ids.extend(ids)

    def encode(self, texts: list[str | None], size: int = 1 << 22) -> list[np.ndarray]:
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        for group in groups_of_texts(texts, size):
            split = pc.split_pattern(pc.replace_substring(pa.array([piece for _, piece in group], pa.large_string()), "\n", " "), " ")
            coded, ends = split.flatten().dictionary_encode(), split.offsets.to_numpy()[1:].tolist()
            chunks = coded.dictionary.to_numpy(zero_copy_only=False)  # each chunk of the group once
            at = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
            if len(self.index) + np.count_nonzero(at < 0) > self.cache:
                self._clear()
                at[:] = -1
            new = np.flatnonzero(at < 0)
            self.learn(chunks[new].tolist())
            at[new] = np.fromiter(map(self.index.__getitem__, chunks[new]), np.int64, len(new))
            at = at[coded.indices.to_numpy()]
            size_, start, table = np.frombuffer(self.size, np.int64)[at], np.frombuffer(self.start, np.int64)[at], np.frombuffer(self.ids, np.uint32) if self.ids else np.zeros(0, np.uint32)
            stop = np.cumsum(size_)
            ids = table[np.repeat(start - (stop - size_), size_) + np.arange(stop[-1])]
            del size_, start, table  # frombuffer holds the arrays, which then could not grow
            a = 0
            for (i, _), e in zip(group, ends, strict=True):
                b = int(stop[e - 1]) if e else 0
                parts[i].append(ids[a:b])
                a = b
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, np.uint32) for p in parts]


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class Packer:
    """Bounded-space best fit.  A piece: (document, start, ids, tokens of the document)."""

    def __init__(self, length: int = LENGTH, windows: int = WINDOWS):
        self.length, self.most = length, windows
        self.open: list[list] = []  # [used, pieces]

    def add(self, doc, ids: np.ndarray) -> Iterator[list]:
        """Sequences (lists of pieces) that are now full."""
        n, whole = len(ids), len(ids) // self.length * self.length
        for s in range(0, whole, self.length):
            yield [(doc, s, ids[s : s + self.length], n)]
        if whole == n:
            return
        rest = n - whole
        fits = [w for w in self.open if w[0] + rest <= self.length]
        if fits:
            w = max(fits, key=lambda w: w[0])
        elif len(self.open) < self.most:
            self.open.append(w := [0, []])
        else:
            full = max(self.open, key=lambda w: w[0])
            gap = self.length - full[0]
            full[1].append((doc, whole, ids[whole : whole + gap], n))
            whole, rest = whole + gap, rest - gap
            yield full[1]
            full[:] = [0, []]
            w = full
        w[1].append((doc, whole, ids[whole:].copy(), n))
        w[0] += rest
        if w[0] == self.length:
            yield w[1]
            self.open.remove(w)

    def finish(self) -> Iterator[list]:
        """The open windows merged; the last partial sequence is cut at powers of two."""
        pieces = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        left, self.open = sum(len(p[2]) for p in pieces), []
        at = 0
        while left:
            size = self.length if left >= self.length else 1 << (left.bit_length() - 1)
            seq, room = [], size
            while room:
                doc, start, ids, n = pieces[at]
                if len(ids) <= room:
                    seq.append(pieces[at])
                    room -= len(ids)
                    at += 1
                else:
                    seq.append((doc, start, ids[:room], n))
                    pieces[at] = (doc, start + room, ids[room:], n)
                    room = 0
            yield seq
            left -= size


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, windows: int = WINDOWS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids."""
    prepare(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    docs = docs.select("doc_id", "text")
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in longs), *([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = tokenizer(path), Packer(length, windows)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 33
        kind = None
        rows: list[tuple] = []

        def put(pieces: list) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, n in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, sequence, offset, *([ids.tolist()] if with_ids else [])))
                offset += len(ids)
            sequence += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            kinds = [kind, *[pa.int64()] * len(longs), *([pa.list_(pa.int64())] if with_ids else [])]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for doc, tokens in zip(ids, encoder.encode(texts), strict=True):
                for seq in packer.add(doc, np.append(tokens, np.uint32(end_id))):
                    put(seq)
                if len(rows) >= 8192:
                    yield out()
        for seq in packer.finish():
            put(seq)
        if rows:
            yield out()

    return docs.mapInArrow(run, schema)
