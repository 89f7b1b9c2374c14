"""SimHash near-dedup by an LSH forest.

A text's shingles are five consecutive lower-cased words (a text of fewer words is one shingle).  Its signature is
a 256-bit SimHash of its distinct shingles.  Each tree of the forest orders the signatures by their bits in its
own random permutation; two texts that share the first ``depth`` permuted bits meet in that tree.

Two passes.  The first starts deep and looks for easy links: in its START trees each text of a prefix with more than ALL
texts proposes its NEAREST nearest within BLOCK rows.  The second climbs: each text's prefix is shortened to the depth
at which, with so many trees, a pair at the similarity threshold becomes a candidate with at least the target recall
(:func:`planned_recall`, exact for 256 shared bits); that depth grows with the logarithm of the number of texts, so a
prefix holds a bounded number of unrelated texts.  It leaves nothing out: of all texts that share a prefix in any tree,
every pair within the Hamming bound that the first pass has not yet put into one class is a candidate (a pair comes
from the first tree in which it meets; pairs whose numbers of shingles alone rule the similarity out are dropped).
So the classes are those of all pairs that meet, while a dense group that the first pass has joined costs no pairs.
Candidates are verified by the Jaccard similarity of their whole shingle sets.  Verified links are joined to classes by
alternating stars.  Links within a class are not counted, as not all of them are looked at.

Equal texts are one node, so copies are never compared.  Verification places the shingles of a candidate's
neighbourhood in one group of bounded size (a large neighbourhood is dealt to blocks), so each shingle set is
moved a few times and not once a pair.  The second pass holds the rows of one prefix at a time (64 bytes a text);
links, classes and signatures stay distributed.

Edge cases.  Null text: empty.  Texts without words (empty ones too) are in a class only with their equals.  A class
without any doc_id takes a hash as its id.  Repeated rows: a row each (keep_one keeps one of them).  Empty table: no rows.  Other
columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, groups_of_texts, materialise, mix64, powers, prepare

SHINGLE, SIMILARITY, RECALL, BITS = 5, 0.8, 0.99, 256
WORDS = BITS // 64
ALL, NEAREST, BLOCK, CROWD, GROUP = 16, 4, 1024, 1024, 512
START, DEEP, LEAST = 12, 16, 10  # trees and least depth of the first pass, least depth of the second
_BASE = 0x9E3779B97F4A7C15
_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_STEPS = mix64(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
_POWERS: dict = {}
#: The bits of a byte, the highest first, as eight counters in a long (as it lies in memory).
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def bit_agreement(similarity: float = SIMILARITY) -> float:
    """Chance that one SimHash bit is the same for two sets of equal size and that Jaccard similarity."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def hamming_bound(similarity: float = SIMILARITY, bits: int = BITS, sigmas: float = 3.2) -> int:
    q = 1 - bit_agreement(similarity)
    return math.floor(bits * q + sigmas * math.sqrt(bits * q * (1 - q)))


def planned_recall(depth: int, trees: int, similarity: float = SIMILARITY, bits: int = BITS) -> float:
    """Chance that a pair of that similarity is a candidate: it differs in a binomial number d of bits, d is within the
    bound, and some tree has none of them among its first depth ones.  All trees permute the same bits, so they are
    independent only for a given d."""
    q = 1 - bit_agreement(similarity)
    return sum(math.comb(bits, d) * q**d * (1 - q) ** (bits - d) * (1 - (1 - math.comb(bits - d, depth) / math.comb(bits, depth)) ** trees) for d in range(hamming_bound(similarity, bits) + 1))


def plan_forest(texts: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(depth, trees): about CROWD unrelated texts a prefix at most, and the trees that the recall needs there."""
    depth = max(LEAST, math.ceil(math.log2(max(1, texts) / CROWD)))
    trees = next((t for t in range(1, 2000) if planned_recall(depth, t, similarity) >= recall), None)
    if trees is None:
        raise ValueError(f"recall {recall} is out of reach at similarity {similarity}")
    return depth, trees


def _powers(n: int):
    if not _POWERS or len(_POWERS["forth"]) < n:
        size = max(n, 1 << 21)
        _POWERS.update(forth=powers(_BASE, size), back=powers(pow(_BASE, -1, 1 << 64), size))
    return _POWERS["forth"], _POWERS["back"]


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text index) of the distinct shingles of each text, in order of text and hash."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(data.tobytes().translate(WORD_BYTES), np.uint8)
    forth, back = _powers(len(data) + 1)
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = data != 32
    edge = np.diff(word)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * forth[: len(data)], out=sums[1:])
    w = mix64((sums[stop] - sums[start]) * back[start])
    own = np.searchsorted(ends, start, side="right")
    count = np.bincount(own, minlength=len(texts))
    first = np.cumsum(count) - count
    # Shingles start at each word that has four more behind it in its text, or at the first word of a short text.
    rank = np.arange(len(w)) - first[own]
    starts = np.flatnonzero((rank + SHINGLE <= count[own]) | (rank == 0))
    size = np.minimum(count[own[starts]], SHINGLE)
    h = size.astype(np.uint64)
    for k in range(SHINGLE):
        more = k < size
        h = h + np.where(more, w[np.minimum(starts + k, max(len(w) - 1, 0))] * _STEPS[k], np.uint64(0))
    h, own = mix64(h), own[starts]
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[new], own[new]


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bits (texts, BITS) of 0 and 1, number of shingles)

    Votes are counted eight bits at a time: each byte of a shingle's hash adds to eight counters in one long, over runs
    of at most 255 shingles of a text; a run's sum is a difference of running sums modulo 2^64.
    """
    h, own = shingle_sets(texts)
    count = np.bincount(own, minlength=len(texts))
    out = np.zeros((len(texts), BITS), np.uint8)
    if len(h):
        some = np.flatnonzero(count)
        runs = -(-count[some] // 255)
        of = np.repeat(np.arange(len(some)), runs)
        within = np.arange(len(of)) - (np.cumsum(runs) - runs)[of]
        begin = (np.cumsum(count) - count)[some]
        start = begin[of] + within * 255
        stop = np.minimum(start + 255, (begin + count[some])[of])
        votes = np.empty((len(of), BITS), np.uint8)
        sums = np.zeros(len(h) + 1, np.uint64)
        for k in range(WORDS):
            octets = mix64(h ^ mix64(np.full(1, 0xA5A5A5A5 + k, np.uint64))).view(np.uint8).reshape(-1, 8)
            for j in range(8):
                np.cumsum(_LANES[octets[:, j]], out=sums[1:])
                at = k * 64 + j * 8
                votes[:, at : at + 8] = (sums[stop] - sums[start]).view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(votes, np.cumsum(runs) - runs, axis=0, dtype=np.int32) * 2
        odd = np.arange(BITS) % 2  # ties go up at odd bits
        out[some] = total + odd > count[some][:, None]
    return out, count


def _as_longs(bits: np.ndarray) -> np.ndarray:
    """(n, BITS) bits to (n, WORDS) unsigned, the first bit highest."""
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(">u8").astype(np.uint64)


def _sign_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        a = 0
        while a < len(texts):
            b, n = a, 0
            while b < len(texts) and (b == a or n + len(texts[b]) < 1 << 20):
                n += len(texts[b])
                b += 1
            bits, count = signatures(texts[a:b])
            s = _as_longs(bits).view(np.int64)
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), *map(pa.array, s.T.copy()), pa.array(count.astype(np.int64))], names=["doc_id", "node", *SIGNATURE, "shingles"])
            a = b


#: The columns of a signature.
SIGNATURE = tuple(f"s{k + 1}" for k in range(WORDS))
_TYPES = ", ".join(f"{c} long" for c in SIGNATURE)


def permutations(trees: int, seed: int = 9) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(BITS) for _ in range(trees)])


def _bits_of(batch: pa.RecordBatch) -> np.ndarray:
    sig = np.stack([batch.column(c).to_numpy() for c in SIGNATURE], axis=1).view(np.uint64).astype(">u8")
    return np.unpackbits(np.ascontiguousarray(sig).view(np.uint8).reshape(-1, BITS // 8), axis=1)


def _keys(bits: np.ndarray, perm: np.ndarray, depth: int, tree: int) -> np.ndarray:
    """The first depth bits of a tree, behind its number."""
    return bits[:, perm[:depth]].astype(np.int64) @ (1 << np.arange(depth - 1, -1, -1, dtype=np.int64)) + (tree << depth)


def _tree_rows(depth: int, trees: int, carry: tuple[str, ...] = ("node",)):
    perms = permutations(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = _bits_of(batch)
            for k, perm in enumerate(perms):
                # The next bits of the tree order the rows of a prefix.
                after = (bits[:, perm[depth : depth + 62]].astype(np.int64) << np.arange(61, -1, -1, dtype=np.int64)).sum(axis=1) if carry == ("node",) else None
                columns = [pa.array(_keys(bits, perm, depth, k)), *([pa.array(after)] if after is not None else []), *(batch.column(c) for c in (*SIGNATURE, *carry))]
                yield pa.RecordBatch.from_arrays(columns, names=["prefix", *(["after"] if after is not None else []), *SIGNATURE, *carry])

    return run


def _distance(p: np.ndarray, i, j) -> np.ndarray:
    d = np.bitwise_count(p[0][i] ^ p[0][j]).astype(np.uint16)
    for row in p[1:]:
        d += np.bitwise_count(row[i] ^ row[j])
    return d


def meet(prefix: np.ndarray, p: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of rows sorted by prefix and signature; p: (WORDS, n) signatures."""
    edge = np.flatnonzero(np.diff(prefix)) + 1
    start, stop = np.concatenate(([0], edge)), np.concatenate((edge, [len(prefix)]))
    size = stop - start
    left, right = [], []
    few = np.repeat(size <= ALL, size)
    for o in range(1, ALL):
        i = np.flatnonzero(few[:-o] & (prefix[:-o] == prefix[o:])) if o < len(prefix) else np.zeros(0, int)
        if not len(i):
            break
        i = i[_distance(p, i, i + o) <= bound]
        left.append(i)
        right.append(i + o)
    for s, e in zip(start[size > ALL], stop[size > ALL], strict=True):
        for a in range(s, e, BLOCK // 2):
            b = min(a + BLOCK, e)
            d = _distance(p, np.arange(a, b)[:, None], np.arange(a, b)[None, :])
            np.fill_diagonal(d, 2 * BITS)
            k = min(NEAREST, b - a - 1)
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            i = np.repeat(np.arange(b - a), k)
            j = near.ravel()
            keep = d[i, j] <= bound
            left.append(i[keep] + a)
            right.append(j[keep] + a)
            if b == e:
                break
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _meet_rows(bound: int):
    def pairs(rows: np.ndarray) -> pa.RecordBatch:
        i, j = meet(rows[0], rows[1:-1].view(np.uint64), bound)
        a, b = np.minimum(rows[-1][i], rows[-1][j]), np.maximum(rows[-1][i], rows[-1][j])
        ab = np.unique(np.stack((a, b), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ab[:, 0])), pa.array(np.ascontiguousarray(ab[:, 1]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in ("prefix", *SIGNATURE, "node")]))
            n += held[-1].shape[1]
            if n >= 1 << 17:
                rows = np.concatenate(held, axis=1)
                whole = int(np.searchsorted(rows[0], rows[0][-1]))  # the last prefix may go on
                if not whole and n >= 1 << 18:
                    whole = n - BLOCK  # one very dense prefix: its order goes on with a block of overlap
                    yield pairs(rows)
                elif whole:
                    yield pairs(rows[:, :whole])
                held, n = [rows[:, whole:]], rows.shape[1] - whole
        if n:
            yield pairs(np.concatenate(held, axis=1))

    return run


def masks(perms: np.ndarray, depth: int) -> np.ndarray:
    """(trees, WORDS) unsigned: the signature bits that are the first depth ones of each tree."""
    bits = np.zeros((len(perms), BITS), np.uint8)
    np.put_along_axis(bits, perms[:, :depth], 1, axis=1)
    return _as_longs(bits)


def apart(rows: np.ndarray, depth: int, seen: np.ndarray, bound: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All candidate pairs of rows (prefix, the signature's columns, node, label, shingles; sorted by prefix) that share a prefix, are within the
    bound and not of one label (0: none yet), each pair in the first tree in which it meets; seen: masks of the trees."""
    prefix, s, label, size = rows[0], rows[1 : 1 + WORDS].view(np.uint64), rows[2 + WORDS], rows[3 + WORDS]

    def kept(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = ((label[i] != label[j]) | (label[i] == 0)) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9)
        i, j = i[ok], j[ok]
        if len(i):
            x, tree = s[:, i] ^ s[:, j], prefix[i] >> depth
            met = np.zeros(len(i), bool)
            for t in range(int(tree.max())):
                same = t < tree
                for k in range(WORDS):
                    same &= x[k] & seen[t, k] == 0
                met |= same
            i, j = i[~met], j[~met]
        return i, j

    edge = np.flatnonzero(np.diff(prefix)) + 1
    start, stop = np.concatenate(([0], edge)), np.concatenate((edge, [len(prefix)]))
    count = stop - start
    few = np.repeat(count <= ALL, count)
    for o in range(1, min(ALL, len(prefix))):
        i = np.flatnonzero(few[:-o] & (prefix[:-o] == prefix[o:]))
        if not len(i):
            break
        i = i[_distance(s, i, i + o) <= bound]
        yield kept(i, i + o)
    for a, b in zip(start[count > ALL], stop[count > ALL], strict=True):
        # The largest class comes last: its texts need not be compared with one another.
        own, n = np.unique(label[a:b][label[a:b] != 0], return_counts=True)
        most = label[a:b] == own[n.argmax()] if len(own) else np.zeros(b - a, bool)
        at = a + np.concatenate((np.flatnonzero(~most), np.flatnonzero(most)))
        others, step = int((~most).sum()), max(1, (1 << 21) // (b - a))
        for c in range(0, others, step):
            left, right = at[c : min(c + step, others)], at[c:]
            x, y = np.nonzero(_distance(s, left[:, None], right[None, :]) <= bound)
            x, y = x[x < y], y[x < y]
            for k in range(0, len(x), 1 << 18):
                yield kept(left[x[k : k + (1 << 18)]], right[y[k : k + (1 << 18)]])


def _apart_rows(depth: int, trees: int, bound: int, similarity: float):
    names, seen = ("prefix", *SIGNATURE, "node", "label", "shingles"), masks(permutations(trees), depth)

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i, j in apart(rows, depth, seen, bound, similarity):
            if len(i):
                a, b = rows[1 + WORDS][i], rows[1 + WORDS][j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, limit = [], 0, 1 << 17
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in names]))
            n += held[-1].shape[1]
            if n >= limit:
                rows = np.concatenate(held, axis=1)
                whole = int(np.searchsorted(rows[0], rows[0][-1]))  # the last prefix may go on
                if whole:
                    yield from pairs(rows[:, :whole])
                held, n = [rows[:, whole:].copy()], n - whole
                limit = max(1 << 17, 2 * n)
        if n:
            yield from pairs(np.concatenate(held, axis=1))

    return run


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        a = 0
        while a < len(texts):
            b, n = a, 0
            while b < len(texts) and (b == a or n + len(texts[b]) < 1 << 20):
                n += len(texts[b])
                b += 1
            h, own = shingle_sets(texts[a:b])
            offsets = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=b - a)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))], names=["node", "set"])
            a = b


def _verified(similarity: float):
    """Groups sorted so that a group's shingle sets come before its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sets = None, {}
        for batch in batches:
            left, right = [], []
            g, node, other = (batch.column(c).to_pylist() for c in ("g", "node", "other"))
            values = batch.column("set")
            for k in range(len(g)):
                if g[k] != group:
                    group, sets = g[k], {}
                if other[k] is None:
                    sets[node[k]] = set(values[k].values.to_pylist())
                    continue
                x, y = sets[node[k]], sets[other[k]]
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    continue
                common = len(x & y)
                if common >= similarity * (len(x) + len(y) - common) - 1e-9:
                    left.append(node[k])
                    right.append(other[k])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): the least node of each component, by alternating large and small stars."""
    edges, before = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "near-edges"), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        joined = large.join(least, F.col("a") == F.col("u"))
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = materialise(small.distinct(), "near-stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"classes did not settle in {rounds} rounds")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def node_of(text) -> "F.Column":
    """A text's node: a hash of it, so that equal texts are one node."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit(31))


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, node, s1, s2, shingles) of each row: hash of the text, signature, number of shingles."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node_of(F.col("text")).alias("node"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return base.mapInArrow(_sign_rows, f"doc_id long, node long, {_TYPES}, shingles long")


def near_candidates(nodes: DataFrame, similarity: float, n: int) -> DataFrame:
    """Pairs of the first pass: each text with its nearest."""
    depth = max(DEEP, math.ceil(math.log2(max(1, n) / CROWD)) + DEEP - LEAST)
    rows = nodes.select("node", *SIGNATURE).mapInArrow(_tree_rows(depth, START), f"prefix long, after long, {_TYPES}, node long")
    dealt = rows.repartition("prefix").sortWithinPartitions("prefix", "after")
    return dealt.mapInArrow(_meet_rows(hamming_bound(similarity)), "a long, b long").distinct()


def other_candidates(nodes: DataFrame, roots: DataFrame, similarity: float, recall: float, n: int) -> DataFrame:
    """Pairs of the second pass: all that meet and are not of one class yet; roots: (node, root) of the first pass."""
    depth, trees = plan_forest(n, similarity, recall)
    labelled = nodes.join(roots, "node", "left").select(*SIGNATURE, "node", F.coalesce("root", F.lit(0).cast("long")).alias("label"), "shingles")
    rows = labelled.mapInArrow(_tree_rows(depth, trees, ("node", "label", "shingles")), f"prefix long, {_TYPES}, node long, label long, shingles long")
    dealt = rows.repartition("prefix").sortWithinPartitions("prefix")
    return dealt.mapInArrow(_apart_rows(depth, trees, hamming_bound(similarity), similarity), "a long, b long")


def verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose whole shingle sets reach the similarity."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    crowd = near.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    block = F.xxhash64("label", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / GROUP)))
    placed = materialise(near.join(crowd, "label").select("node", block.alias("block")), "near-blocks")
    x = pairs.join(placed.select(F.col("node").alias("a"), F.col("block").alias("x")), "a").join(placed.select(F.col("node").alias("b"), F.col("block").alias("y")), "b")
    grouped = materialise(x.select(F.xxhash64(F.least("x", "y"), F.greatest("x", "y")).alias("g"), "a", "b"), "near-groups")
    need = grouped.select("g", F.explode(F.array("a", "b")).alias("node")).distinct()
    # One of a node's documents gives its text.
    lowest = F.lit(-(2**63)).cast("long")
    wanted = placed.select("node").join(nodes.select("node", F.coalesce("doc_id", lowest).alias("key")), "node")
    base = docs.select(node_of(F.col("text")).alias("node"), F.coalesce(F.col("doc_id").cast("long"), lowest).alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sets = base.join(wanted, ["node", "key"]).select("node", "text").mapInArrow(_shingle_rows, "node long, set array<long>")
    none = F.lit(None)
    rows = need.join(sets, "node").select("g", "node", none.cast("long").alias("other"), "set").unionByName(grouped.select("g", F.col("a").alias("node"), F.col("b").alias("other"), none.cast("array<long>").alias("set")))
    dealt = rows.repartition("g").sortWithinPartitions("g", F.col("other").isNotNull())
    return dealt.mapInArrow(_verified(similarity), "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), class_docs, kept (the class's first document) and text_hash
    (equal for equal texts), per row of docs."""
    prepare(docs.sparkSession)
    rows = materialise(signed(docs), "near-signed")
    nodes = materialise(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in SIGNATURE), F.first("shingles").alias("shingles")), "near-nodes")
    worded = nodes.where("shingles > 0")
    n = worded.count()
    easy = materialise(near_candidates(worded, similarity, n), "near-pairs")
    links = materialise(verify(docs, nodes, easy, similarity), "near-links")
    roots = components(links)
    roots = materialise(roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct(), "near-roots")
    other = materialise(other_candidates(worded, roots, similarity, recall, n).join(easy, ["a", "b"], "left_anti"), "near-others")
    more = materialise(verify(docs, nodes, other, similarity), "near-more")
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    classed = nodes.join(roots, "node", "left").select("node", "doc_id", "copies", F.coalesce("root", "node").alias("root"))
    classed = materialise(classed, "near-classed")
    whole = classed.groupBy("root").agg(F.sum("copies").alias("class_docs"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("head"))
    full = classed.join(whole, "root").select("node", F.coalesce("head.doc_id", "root").alias("class_id"), "class_docs", "head")
    out = rows.select("doc_id", "node").join(full, "node")
    return out.select("doc_id", "class_id", "class_docs", (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("node") == F.col("head.node"))).alias("kept"), F.col("node").alias("text_hash"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of docs that stay: one document of each class, with all of its columns."""
    kept = near_duplicates(docs, similarity, recall).where("kept").select(F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("__key"), F.col("text_hash").alias("__node")).distinct()
    kept = materialise(kept, "near-kept")
    marked = docs.withColumn("__node", node_of(F.col("text"))).withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")))
    return marked.join(kept, ["__node", "__key"], "left_semi").dropDuplicates(["__node", "__key"]).select(*docs.columns)
