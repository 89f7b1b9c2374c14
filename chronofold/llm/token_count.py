"""Token counts by trie-shared dynamic programming over a unigram model of a public vocabulary.

Pre-tokens are the words between white space, each with a leading word mark.  The distinct ones are put into
a trie: sorted, a word's shared prefix with the one before it is the trie path they share, and forward scores
(best log probability of a segmentation of the prefix, and its number of tokens) are computed once per trie
node and dropped when the walk leaves it.  Terminal counts are stored by word; a text's count is the sum.

Scores: the vocabulary's pieces by rank under Zipf's law, log p = -log(rank + 1); a character that no piece
covers costs ten more than the rarest piece and counts one token per UTF-8 byte.  Of equal scores the longest
last piece wins.

Plan: one narrow pass, no shuffle; a worker holds a bounded cache of words.

Edge cases.  Null or blank text: no tokens.  Repeated documents: a row each.  Null ids are kept.  A word of any
length is one path (linear time).  Empty table: no rows.  Other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import groups_of_texts, prepare

MARK, CACHE = "▁", 500_000
_MODELS: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def zipf_scores(path: str) -> dict[str, float]:
    """Log probabilities of the vocabulary's ordinary pieces, by rank."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    return {p: -math.log(r + 2) for r, p in enumerate(pieces)}


class TrieCounter:
    def __init__(self, scores: dict[str, float], cache: int = CACHE):
        self.cache, self.counts = cache, {}
        self.unknown = min(scores.values(), default=0.0) - 10
        # Pieces by their characters from the end: [score or None, {previous character: node}].
        self.root: dict = {}
        for piece, score in scores.items():
            level, node = self.root, None
            for c in reversed(piece):
                node = level.setdefault(c, [None, {}])
                level = node[1]
            node[0] = score

    def learn(self, words: set[str]) -> None:
        """Terminal counts of new words, in one walk of their trie."""
        root, unknown, counts = self.root, self.unknown, self.counts
        path, best, count = "", [0.0], [0]
        for word in sorted(words):
            token = MARK + word
            shared, most = 0, min(len(token), len(path))
            while shared < most and token[shared] == path[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for i in range(shared, len(token)):
                c = token[i]
                high, n = best[i] + unknown, count[i] + len(c.encode("utf-8", "surrogatepass"))
                j, node = i, root.get(c)
                while node is not None:
                    s = node[0]
                    if s is not None and best[j] + s >= high:
                        high, n = best[j] + s, count[j] + 1
                    j -= 1
                    if j < 0:
                        break
                    node = node[1].get(token[j])
                best.append(high)
                count.append(n)
            path = token
            counts[word] = count[-1]

    def count(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """(tokens, words) of each text."""
        tokens, words = [0] * len(texts), [0] * len(texts)
        for group in groups_of_texts(texts):
            split = [(i, piece.split()) for i, piece in group]
            seen = set().union(*(w for _, w in split))
            new = seen.difference(self.counts)
            if len(self.counts) + len(new) > self.cache:
                self.counts.clear()
                new = seen
            self.learn(new)
            get = self.counts.__getitem__
            for i, w in split:
                tokens[i] += sum(map(get, w))
                words[i] += len(w)
        return tokens, words


def counter(path: str) -> TrieCounter:
    if path not in _MODELS:
        _MODELS[path] = TrieCounter(zipf_scores(path))
    return _MODELS[path]


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens per row of docs."""
    prepare(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, words = counter(path).count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=schema.names)

    return docs.mapInArrow(run, schema)
