"""Document fingerprints [native]: I-Match over randomised lexicon subsets.

Terms are a text's distinct lower-cased words, as 64-bit hashes.  The lexicon is the terms within a band of
inverse document frequency: those held by MIN_SHARE to MAX_SHARE of all documents (idf 3 to 8).  A text keeps its
terms that are in the lexicon.  The lexicon is dealt to CELLS random cells by a hash of the term.  A subset is six cells
in a row (a quarter of the lexicon; there are CELLS such rows), one cell, or one cell's terms of which further hash bits
are 0 (a quarter of it for each two bits, LEVELS in all, down to 1/6144 of the lexicon).  The fingerprint is a 64-bit
hash of all kept terms and a 15-bit hash of those in each of the CELLS subsets of each rate, for every text.
A set's hash is the exclusive or of its terms' hashes: distinct terms in any order give what hashing their sorted list
gives, without a sort, and one aggregation by cell serves all subsets.  0 is the hash of no terms.  Equal texts have
equal fingerprints.

The likeness of two fingerprints is the share of equal hashes among the subsets that are not empty for both, at
the rate where that share is largest, counting only rates with MIN_FILLED such subsets; texts with very few terms
are compared over all subsets.  Equal fingerprints have likeness 1.

A text with fewer than MIN_TERMS lexicon terms takes all of its terms instead (or, without any, its whole text).

Size: terms held by at least MIN_SHARE of N documents number at most (mean distinct terms a document) /
MIN_SHARE, whatever N is; that table is broadcast if it is no more than LEXICON_ROWS rows, else joined.

Only DataFrame functions are used.  Shuffles: term counts (pre-aggregated), each text once, the text given to
its predecessor (at most a third), and one fingerprint a text.

Edge cases.  Null text: empty.  The next document is the next distinct (doc_id, text) in descending doc_id,
null ids last, ties by a hash of the text; repeated rows share one result and keep a row each.  A table of one
document is its own next.  Empty table: no rows.  Ids are cast to long (text that is no number fails).  Other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, prepare, small_side

MIN_SHARE, MAX_SHARE, LEXICON_ROWS = 0.0004, 0.05, 2_000_000
CELLS, LEVELS, ROW = 24, 5, 6  # a level keeps a quarter of the one before
RATES = LEVELS + 1
MIN_TERMS, MIN_FILLED = 4, 6


def term_hashes(text: Column) -> Column:
    """Distinct hashes of the text's words, in no order."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(texts: DataFrame, n: int) -> DataFrame:
    """(term): hashes held by MIN_SHARE to MAX_SHARE of the n documents, and by two at least."""
    df = texts.select(F.explode(term_hashes(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.where((F.col("df") >= max(2, MIN_SHARE * n)) & (F.col("df") <= max(2, MAX_SHARE * n))).select("term")


def _once(value: Column, use) -> Column:
    """use(value), where use reads value many times: a lambda's variable is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _mixed(term: Column) -> Column:
    return F.xxhash64(term)


def set_hash(term: Column) -> Column:
    """What a term adds to the hash of a set."""
    return F.xxhash64(_mixed(term))


def cell_of(term: Column) -> Column:
    return F.pmod(_mixed(term), F.lit(CELLS)).cast("int")


def at_level(term: Column, level: int) -> Column:
    """Whether a term is in its cell's subset of that level."""
    return F.shiftrightunsigned(_mixed(term), 32).bitwiseAND(F.lit((1 << 2 * level) - 1)) == 0


def _short(x: Column) -> Column:
    """15 bits of a set's hash and a 1; 0 for no terms."""
    return F.when(x == 0, F.lit(0)).otherwise(F.shiftrightunsigned(x, 16).bitwiseAND(F.lit(0x7FFF)).bitwiseOR(F.lit(1))).cast("smallint")


def subsets_of(cells: Column) -> Column:
    """Fingerprint from CELLS structs (l0 .. of the levels' hashes): the hash of all terms in four parts, then each rate's."""
    numbers = F.array(*(F.lit(c) for c in range(CELLS)))

    def xor(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s.bitwiseXOR(v))

    def level(cs: Column, k: int) -> Column:
        return F.transform(cs, lambda c: _short(c[f"l{k}"]))

    def all_(cs: Column) -> Column:
        first = F.transform(cs, lambda c: c["l0"])
        whole = _once(xor(first), lambda x: F.array(*(F.shiftrightunsigned(x, k).bitwiseAND(F.lit(0xFFFF)) - 0x8000 for k in (48, 32, 16, 0))))
        rows = _once(F.concat(first, first), lambda two: F.transform(numbers, lambda c: _short(xor(F.slice(two, c + 1, F.lit(ROW))))))
        return F.concat(F.transform(whole, lambda x: x.cast("smallint")), rows, *(level(cs, k) for k in range(LEVELS)))

    return _once(cells, all_)


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, from 0 to 1."""
    pairs = F.zip_with(F.slice(a, 5, CELLS * RATES), F.slice(b, 5, CELLS * RATES), lambda x, y: F.when((x == 0) & (y == 0), F.lit(None)).otherwise(F.when(x == y, 1).otherwise(0)))

    def best(found: Column) -> Column:
        parts = [F.filter(F.slice(found, 1 + k * CELLS, CELLS), lambda x: x.isNotNull()) for k in range(RATES)]
        filled = F.filter(found, lambda x: x.isNotNull())
        share = lambda x, least: _once(x, lambda p: F.when(F.size(p) >= least, F.aggregate(p, F.lit(0), lambda s, v: s + v).cast("double") / F.size(p)))
        return F.coalesce(F.greatest(*(share(p, MIN_FILLED) for p in parts)), share(filled, 1), F.lit(0.0))

    return F.when(a == b, 1.0).otherwise(_once(pairs, best))


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x.cast("int").bitwiseAND(F.lit(0xFFFF))), 4, "0")), "")


def _sha_longs(text: Column) -> Column:
    """A text's checksum as four longs, which a hash aggregation holds in place; a string would make it sort its rows."""
    return _once(F.sha2(text, 256), lambda s: F.struct(*(F.conv(F.substring(s, 1 + 16 * k, 16), 16, -10).cast("long").alias(f"s{k}") for k in range(4))))


def _sha_text(parts: Column) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(parts[f"s{k}"]), 16, "0") for k in range(4))))


def fingerprint_pairs(texts: DataFrame, lex: DataFrame) -> DataFrame:
    """(k1, k2, fa, fe, sha): fingerprints of text and edited, and the checksum of edited; one row a key.

    The terms are exploded, looked up and added up by cell where the texts lie: no shuffle if the lexicon is broadcast.
    All that is added up by cell is a long, so that this is a hash aggregation and the terms are never sorted.
    A row without a term keeps texts that have none.
    """
    side = lambda e, text, sha: F.struct(F.lit(e).alias("e"), term_hashes(F.col(text)).alias("ts"), F.xxhash64(text, F.lit(3)).alias("w"), sha.alias("s"))
    sha, no_sha = [f"s{k}" for k in range(4)], F.struct(*(F.lit(0).cast("long").alias(f"s{k}") for k in range(4)))
    both = texts.select("k1", "k2", F.explode(F.array(side(0, "text", no_sha), side(1, "edited", _sha_longs(F.col("edited"))))).alias("x"))
    each = both.select("k1", "k2", "x.e", "x.w", "x.s.*", F.explode_outer("x.ts").alias("term"))
    found = each.join(small_side(lex.select("term", F.lit(True).alias("in_band")), LEXICON_ROWS), "term", "left")
    term, zero = F.col("term"), F.lit(0).cast("long")
    added = found.select("k1", "k2", "e", "w", *sha, "term", "in_band", cell_of(term).alias("cell"), set_hash(term).alias("h"))
    sums = [F.coalesce(F.bit_xor(F.when(at_level(term, k) & (F.col("in_band") if band else term.isNotNull()), F.col("h"))), zero).alias(f"{name}{k}") for name, band in (("a", False), ("b", True)) for k in range(LEVELS)]
    cells = added.groupBy("k1", "k2", "e", "cell").agg(*sums, F.count("term").alias("terms"), F.count("in_band").alias("band"), *(F.max(c).alias(c) for c in ("w", *sha)))
    named = lambda name: F.struct(*(F.col(f"{name}{k}").alias(f"l{k}") for k in range(LEVELS)))
    held = F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("cell", named("a").alias("a"), named("b").alias("b"))))
    kept = cells.groupBy("k1", "k2", "e").agg(held.alias("cells"), F.sum("terms").alias("terms"), F.sum("band").alias("band"), *(F.max(c).alias(c) for c in ("w", *sha)))
    none, w = F.struct(*(zero.alias(f"l{k}") for k in range(LEVELS))), F.col("w")
    numbers = F.array(*(F.lit(c) for c in range(CELLS)))
    own = lambda name: _once(F.map_from_entries(F.transform("cells", lambda c: F.struct(c["cell"], c[name]))), lambda m: F.transform(numbers, lambda c: F.coalesce(F.try_element_at(m, c), none)))
    whole = F.transform(numbers, lambda c: F.when(c == cell_of(w), F.struct(*(F.when(at_level(w, k), set_hash(w)).otherwise(zero).alias(f"l{k}") for k in range(LEVELS)))).otherwise(none))
    pick = F.when(F.col("band") >= MIN_TERMS, own("b")).when(F.col("terms") > 0, own("a")).otherwise(whole)
    fp = kept.select("k1", "k2", "e", F.when(F.col("e") == 1, _sha_text(F.struct(*sha))).alias("sha"), subsets_of(pick).alias("fp"))
    of = lambda e: F.max(F.when(F.col("e") == e, F.col("fp")))
    return fp.groupBy("k1", "k2").agg(F.max("sha").alias("sha"), of(0).alias("fa"), of(1).alias("fe"))


def next_rows(rows: DataFrame) -> DataFrame:
    """Each distinct (k1, k2) with its next in descending order (next1, next2), the last row's being the first.

    Rows are dealt to ranges; the next row is a window's lead within a range, and the one after a range's last
    row is the first of the next range that has any (one row a range).
    """
    dealt = rows.repartitionByRange(F.desc("k1"), F.desc("k2")).withColumn("range", F.spark_partition_id())
    dealt = materialise(dealt, "imatch-order")  # so that every use sees the same ranges
    here = F.struct("k1", "k2")
    led = dealt.withColumn("next", F.lead(here).over(Window.partitionBy("range").orderBy(F.desc("k1"), F.desc("k2"))))
    heads = dealt.groupBy("range").agg(F.max(here).alias("head"))
    ordered = Window.orderBy("range")
    ends = heads.select("range", F.coalesce(F.lead("head").over(ordered), F.first("head").over(ordered)).alias("after"))
    full = led.join(F.broadcast(ends), "range").withColumn("next", F.coalesce("next", "after"))
    return full.drop("range", "after").select("*", F.col("next.k1").alias("next1"), F.col("next.k2").alias("next2")).drop("next")


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row of docs."""
    prepare(docs.sparkSession)
    text, lowest = F.coalesce(F.col("text"), F.lit("")), F.lit(-(2**63)).cast("long")
    # The key (k1, k2): the id, null ids lowest, and a hash of the text.
    base = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), lowest).alias("k1"), F.xxhash64(text, F.when(F.col("doc_id").isNull(), 12).otherwise(11)).alias("k2"), text.alias("text"))
    sizes = base.groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.first(F.char_length("text")).alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    order = materialise(next_rows(sizes), "imatch-next")
    n = order.agg(F.sum("copies")).first()[0] or 0
    lex = materialise(lexicon(base, max(1, n)), "imatch-lexicon")

    one = base.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    # What each document gives to the one before it: its first floor(n_chars / 3) code points, that one's n_chars.
    wanted = order.select(F.col("next1").alias("k1"), F.col("next2").alias("k2"), F.col("k1").alias("to1"), F.col("k2").alias("to2"), F.floor(F.col("n_chars") / 3).cast("int").alias("k"))
    given = one.join(wanted, ["k1", "k2"]).select(F.col("to1").alias("k1"), F.col("to2").alias("k2"), F.substring(F.col("text"), F.lit(1), F.col("k")).alias("head"))
    chars = F.char_length("text")
    edited = one.join(given, ["k1", "k2"]).select("k1", "k2", "text", F.concat(F.substring(F.col("text"), F.lit(1), (chars - F.floor(chars / 3)).cast("int")), F.col("head")).alias("edited"))
    fp = materialise(fingerprint_pairs(edited, lex), "imatch-fp")

    after = fp.select(F.col("k1").alias("next1"), F.col("k2").alias("next2"), F.col("fa").alias("fn"))
    x = order.join(fp, ["k1", "k2"]).join(after, ["next1", "next2"])
    x = x.withColumn("near_edited", likeness(F.col("fa"), F.col("fe"))).withColumn("near_next", likeness(F.col("fa"), F.col("fn")))
    x = x.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return x.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), as_text(F.col("fa")).alias("fingerprint"), as_text(F.col("fe")).alias("edited_fingerprint"), "near_edited", "near_next")
