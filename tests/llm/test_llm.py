"""Training-data operators against brute force, edge cases included."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.llm import decontaminate, html_extract, imatch, lang_id, line_dedup, lm_score, packing, simhash_forest, suffix_dedup, token_count

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, n_words long, score string"  # the last two clash with output names


def texts():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = make(150)
    passage = make(110)
    near = base.split(" ")
    near[70] = "changed"
    out = [base, base, " ".join(near), make(40), "", None, "Word.", "!!! ...", make(30) + " " + passage + " " + make(25), passage + "\n" + make(60), "ab" * 700, make(6000)]
    line = "A shared line that is long enough to count"
    out += [f"{make(12)}\n{line}\n{make(9)}", f"  {line.upper()}\t\n{make(8)}", f"{make(5)}\n{line}", "x\n\ny\n"]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i, t, ("en", "fr")[i % 2], 1, "z") for i, t in enumerate(texts())] + [(None, "a text without id", None, 1, "z"), (None, None, None, 1, "z")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def test_decontaminate(spark, docs, rows, empty):
    t = {r[0]: r[1] for r in rows}
    items = [(1, " ".join(t[0].split(" ")[10:40])), (2, "Word"), (3, None), (4, ""), (None, t[3][:80]), (1, t[0][:60])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (8 << 20, 64):
        found = decontaminate.find_benchmark_words(docs, bench, block_bytes=block, with_spans=True)
        got = by_id(found)
        for i, text in t.items():
            if i is None:
                continue
            ws = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
            hit, ids = set(), set()
            for item, it in items:
                iw = WORD.findall((it or "").lower())
                n = min(13, len(iw))
                wins = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
                for k in range(len(ws) - n + 1 if n else 0):
                    if tuple(ws[k : k + n]) in wins:
                        hit |= set(range(k, k + n))
                        ids |= {str(item)} if item is not None else set()
            assert got[i].n_words == len(ws) and sum(e - s for s, e in got[i].hit_words) == len(hit) and got[i]["items"] == sorted(ids)
            assert [x for s, e in got[i].hit_spans for x in WORD.findall(text[s:e].lower())] == [ws[k] for k in sorted(hit)]
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_clean_drops_windows_and_cuts_short_items(spark):
    item = " ".join(f"q{i}" for i in range(20))
    long = " ".join(f"w{i}" for i in range(900))
    rows = [(1, f"{long} {item} {long}"), (2, long), (3, f"{long}, Short  item! {long}"), (4, "short item"), (5, None), (6, ""), (7, f"{long} {item[:40]}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS lang")
    kept = decontaminate.clean(docs, spark.createDataFrame([(1, item), (2, "Short item")], "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert {r.doc_id: r.text for r in kept.collect()} == {2: long, 3: f"{long}, ! {long}", 5: None, 6: "", 7: f"{long} {item[:40]}"}


def test_automaton_is_fed_only_runs_that_may_hold_a_window():
    rng = random.Random(8)
    fed = []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def iter(self, x):
            fed.append(len(x))
            return self.inner.iter(x)

    for window in (1, 3, 13):
        for _ in range(300):
            vocab = "abcdefgh"[: rng.randint(2, 8)]
            items = [(str(i), " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 15)))) for i in range(rng.randint(1, 4))]
            found = decontaminate.build_automaton(items, window)
            wins = {}
            for i, t in items:
                ws = t.split(" ")
                n = min(window, len(ws))
                for k in range(len(ws) - n + 1):
                    wins.setdefault(tuple(ws[k : k + n]), set()).add(i)
            ws = [rng.choice(vocab + "z") for _ in range(rng.randint(0, 40))]
            at = [(k, w) for w in wins for k in range(len(ws) - len(w) + 1) if tuple(ws[k : k + len(w)]) == w]
            n, ranges, ids = decontaminate.scan(found, " ".join(ws))
            assert n == len(ws) and ids == set().union(*(wins[w] for _, w in at))
            assert {j for s, e in ranges for j in range(s, e)} == {j for k, w in at for j in range(k, k + len(w))}
    item = " ".join(f"q{i}" for i in range(20))
    windows = decontaminate.build_automaton([("1", item)], 13)
    windows.automaton = Counted(windows.automaton)
    back = " ".join(reversed(item.split(" ")))  # words of the item, but no two in a row
    assert decontaminate.scan(windows, f"{back} {back}")[1:] == ([], set()) and fed == []
    assert decontaminate.scan(windows, f"{back} {item} {back}") == (60, [(20, 40)], {"1"}) and fed == [20]


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/x>menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <div class="ad">buy</div><div class="content c12"><h1>Head &amp; line</h1><p>One <b>bold</b>&nbsp;word<br>next<p>Two</div><aside>side</aside><div id="comments"><p>I disagree a lot with all of this and write long</p></div><form>f</form><script>var t="</p>";</script><footer>&copy; x</footer>"""
    assert html_extract.extract_page(page) == "Head & line One bold word next Two"
    assert html_extract.extract_page(None) == html_extract.extract_page("") == html_extract.extract_page("<nav>x</nav>") == ""
    assert html_extract.extract_page("just text &lt;b&gt;") in ("just text <b>", "")


def test_html_keeps_article_text():
    get = html_extract.extract_page
    assert get('<article><p title="the hidden truth">Text here now</p></article>') == "Text here now"
    assert get('<article><p>Lead of the story.</p><section class="story-related-facts"><p>A fact.</p></section></article>') == "Lead of the story. A fact."
    assert get("<article><p>As <math><mi>x</mi></math> grows</p></article>") == "As x grows"
    body = "words of the body go on " * 20
    assert get(f'<body><nav>menu</nav><article><h1>Head</h1><p>lead</p><div class="body"><p>{body}</p></div></article></body>') == f"Head lead {body.strip()}"
    links = "<a href=x>some other story</a> " * 9
    assert get(f'<body><div class="page"><div class="list">{links}</div><div class="text"><p>{body}</p></div></div></body>') == body.strip()
    deep = get("<article><p>" + body + "</p></article>" + "<div>" * 3000 + "x" + "</div>" * 3000)
    assert deep == body.strip()
    assert html_extract.attributes("""class='a b' data-x="role=menu" ID=c hidden""") == {"class": "a b", "id": "c", "hidden": ""}


def test_html_tables(spark):
    schema = "url string, page_id long, html string, text string, n_chars string"
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0
    rows = [("http://a.example/1", 1, "<article><p>one</p></article>", "clash", "x")] * 2 + [(None, None, None, None, None)]
    got = html_extract.extract(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted((r.page_id or 0, r.text) for r in got.collect()) == [(0, ""), (1, "one"), (1, "one")]


def test_html_consensus(spark):
    long = "words and more words " * 10
    pages = [(i, "http://h.example/x", f'<body><div class="main m{i}"><p>{long}</p></div><div class="box"><p>short</p></div></body>') for i in range(8)]
    pages += [(8, "http://h.example/y", '<body><div class="main m9"><p>brief text here</p></div><div class="box"><p>a box with a bit more text</p></div></body>'), (9, None, None)]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0].text == long.strip() and got[8].text == "brief text here" and got[9].text == "" and got[0].n_chars == len(got[0].text)


def test_lines(docs, rows, empty, spark):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = {}
    for i, t, *_ in rows:
        for x in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(x, set()).add(i)
    got = by_id(line_dedup.dedup_lines(docs))
    for i, t, *_ in rows:
        if i is not None:
            lines = (t or "").split("\n")
            kept = [x for x in lines if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and i != max(held[key(x)], key=lambda z: -1 if z is None else z))]
            assert (got[i].text, got[i].n_lines, got[i].n_dropped) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert line_dedup.dedup_lines(empty).count() == 0
    store = line_dedup.LineRuns(spark, fanout=2)
    line = "this line is in every batch of them"
    for k in range(5):
        out = by_id(store.ingest(spark.createDataFrame([(k, f"{line}\nown {k}"), (k + 10, f"{line}\nother")], "doc_id long, text string")))
        assert out[k].text == f"own {k}" and (out[k + 10].text == "other") == (k > 0)
    assert store.known().count() == 1 and len(store.levels) > 1


def test_near_duplicates(docs, rows, empty):
    got = by_id(simhash_forest.near_duplicates(docs))
    assert [got[i].class_id for i in (0, 1, 2)] == [0, 0, 0] and got[0].kept and not got[1].kept and got[0].class_docs == 3
    assert all(got[i].class_id == i for i in (3, 6, 7, 8, 11)) and got[4].class_id == got[5].class_id == 4
    assert simhash_forest.near_duplicates(empty).count() == 0
    kept = simhash_forest.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {0, 3, 4, 6, 7} and kept.where("doc_id in (1, 2, 5)").count() == 0


def test_forest_recall():
    depth, trees = simhash_forest.plan_forest(1000)
    rng = random.Random(5)
    found = 0
    for k in range(60):
        w = [str(rng.random()) for _ in range(300)]
        v = list(w)
        for at in (30, 90, 150, 210, 270):
            v[at] = "new"
        bits, _ = simhash_forest.signatures([" ".join(w).replace(".", "").encode(), " ".join(v).replace(".", "").encode()])
        perms = simhash_forest.permutations(trees)
        found += any((bits[0][p[:depth]] == bits[1][p[:depth]]).all() for p in perms)
    assert found >= 57


def test_forest_recall_at_the_threshold():
    # Pairs of 90 shingles, 80 of them shared: a Jaccard similarity of exactly 0.8.
    rng, n = random.Random(8), 1500
    word = lambda: f"{rng.getrandbits(48):012x}"
    pairs = []
    for _ in range(n):
        w = [word() for _ in range(94)]
        pairs += [" ".join(w).encode(), " ".join(w[:84] + [word() for _ in range(10)]).encode()]
    h, own = simhash_forest.shingle_sets(pairs[:2])
    x, y = set(h[own == 0].tolist()), set(h[own == 1].tolist())
    assert len(x & y) / len(x | y) == 0.8
    depth, trees = simhash_forest.plan_forest(1000)
    bits, _ = simhash_forest.signatures(pairs)
    differ = bits[0::2] != bits[1::2]
    met = np.any([~differ[:, p[:depth]].any(1) for p in simhash_forest.permutations(trees)], axis=0)
    assert (met & (differ.sum(1) <= simhash_forest.hamming_bound())).mean() >= 0.983
    assert simhash_forest.planned_recall(depth, trees) >= 0.99 > simhash_forest.planned_recall(depth, trees - 1)


def test_signatures_count_all_votes():
    rng = random.Random(2)
    texts = [b"", b"one", " ".join(str(rng.random()) for _ in range(900)).encode(), b"a b c d e f"]
    bits, count = simhash_forest.signatures(texts)
    h, own = simhash_forest.shingle_sets(texts)
    for k in range(len(texts)):
        rows = [simhash_forest.mix64(h[own == k] ^ simhash_forest.mix64(np.full(1, 0xA5A5A5A5 + w, np.uint64))).view(np.uint8).reshape(-1, 8) for w in range(simhash_forest.WORDS)]
        votes = np.concatenate([np.unpackbits(r, axis=1).astype(int).sum(axis=0) for r in rows]) if count[k] else np.zeros(simhash_forest.BITS)
        want = votes * 2 + np.arange(simhash_forest.BITS) % 2 > count[k] if count[k] else votes
        assert count[k] == (own == k).sum() and (bits[k] == want).all()


def test_forest_dense_group(spark):
    # Each x is like the 1,500 near copies at 0.73 and like one of their kind, its own p, at 0.83.
    word = lambda *k: hashlib.md5(repr(k).encode()).hexdigest()[:8]
    base = [word(i) for i in range(200)]
    x = [base[:174] + [word("x", k, i) for i in range(26)] for k in range(40)]
    p = [base[:174] + x[k][174:182] + base[182:] for k in range(40)]
    group = [[word("g", k, i) for i in range(4)] + base[4:] for k in range(1500)]
    all_texts = [" ".join(t) for t in group + p + x]
    got = {r.doc_id: r.class_id for r in simhash_forest.near_duplicates(spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(1540)) and sum(got[1540 + k] == 0 for k in range(40)) >= 37


def test_forest_leaves_no_pair_out():
    rng = np.random.default_rng(4)
    depth, trees, n = 6, 5, 700
    many = simhash_forest.BITS
    bits = np.where(rng.random((n, many)) < 0.1, 1 - (seed := rng.integers(0, 2, many)), seed).astype(np.uint8)
    s, perms = simhash_forest._as_longs(bits), simhash_forest.permutations(trees)
    label, size = np.where(np.arange(n) < 400, 7, np.where(np.arange(n) < 450, 9, 0)), rng.integers(80, 120, n)
    key = np.concatenate([bits[:, q[:depth]].astype(np.int64) @ (1 << np.arange(depth - 1, -1, -1)) + (k << depth) for k, q in enumerate(perms)])
    row = np.stack([key, *(np.tile(c, trees) for c in (*s.view(np.int64).T, np.arange(n), label, size))])
    row = row[:, np.argsort(row[0], kind="stable")]
    at = 1 + simhash_forest.WORDS
    found = [tuple(sorted((row[at][a], row[at][b]))) for i, j in simhash_forest.apart(row, depth, simhash_forest.masks(perms, depth), 48, 0.8) for a, b in zip(i, j)]
    far = (bits[:, None, :] != bits[None, :, :]).sum(2)
    meet = sum((bits[:, None, q[:depth]] == bits[None, :, q[:depth]]).all(2) for q in perms) > 0
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if meet[i, j] and far[i, j] <= 48 and (label[i] != label[j] or label[i] == 0) and min(size[i], size[j]) >= 0.8 * max(size[i], size[j])}
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 1000


def test_imatch(docs, rows, empty):
    got = by_id(imatch.fingerprint(docs))
    order = sorted({(i if i is not None else -(2**63), t or "") for i, t, *_ in rows}, key=lambda x: -x[0])
    ids = [i for i, _ in order if i >= 0]
    for a, b in zip(ids, ids[1:]):
        t, nxt = (rows[a][1] or ""), (rows[b][1] or "")
        k = len(t) // 3
        assert got[a].edited_sha256 == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest() and got[a].n_chars == len(t)
        assert 0 <= got[a].near_edited <= 1 and 0 <= got[a].near_next <= 1
    assert got[0].fingerprint == got[1].fingerprint != got[3].fingerprint and got[1].near_next == 1.0
    assert imatch.fingerprint(docs).count() == len(rows) and imatch.fingerprint(empty).count() == 0


def brute_fingerprint(words: set, lexicon: set) -> list[int]:
    """Fingerprint of a text with some words, subset by subset."""
    import struct

    import xxhash

    h = lambda x: xxhash.xxh64(struct.pack("<Q", x), seed=42).intdigest()
    terms = {xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words}
    kept = terms & lexicon if len(terms & lexicon) >= imatch.MIN_TERMS else terms
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def digest(subset: set) -> int:
        x = 0
        for t in subset:
            x ^= h(h(t))
        return x >> 16 & 0x7FFF | 1 if x else 0

    cells = [{t for t in kept if signed(h(t)) % imatch.CELLS == c} for c in range(imatch.CELLS)]
    x = 0
    for t in kept:
        x ^= h(h(t))
    out = [(x >> k & 0xFFFF) - 0x8000 & 0xFFFF for k in (48, 32, 16, 0)]
    out += [digest(set().union(*(cells[(c + k) % imatch.CELLS] for k in range(imatch.ROW)))) for c in range(imatch.CELLS)]
    for level in range(imatch.LEVELS):
        out += [digest({t for t in cell if (h(t) >> 32) % (1 << 2 * level) == 0}) for cell in cells]
    return out


def brute_likeness(a: list[int], b: list[int]) -> float:
    if a == b:
        return 1.0
    pairs, n = list(zip(a, b))[4:], imatch.CELLS
    shares = []
    for k in range(imatch.RATES):
        filled = [x == y for x, y in pairs[k * n : (k + 1) * n] if x or y]
        if len(filled) >= imatch.MIN_FILLED:
            shares.append(sum(filled) / len(filled))
    filled = [x == y for x, y in pairs if x or y]
    return max(shares) if shares else sum(filled) / len(filled) if filled else 0.0


def unpacked(fp: str) -> list[int]:
    return [int(fp[k : k + 4], 16) for k in range(0, len(fp), 4)]


def test_imatch_against_brute_force(spark):
    import xxhash

    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    sizes = [rng.choice((0, 1, 3, 8, 40, 200, 900, 2500)) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate(sizes)]
    rows[7] = (7, rows[8][1])
    rows += [(60, "Same Words here, same words HERE"), (61, "ünïcödé ünïcödé 漢字 x")]
    got = by_id(imatch.fingerprint(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    split = lambda t: {w for w in re.split(r"[\W_]+", t.lower()) if w}
    df = Counter(w for _, t in rows for w in split(t))
    lexicon = {xxhash.xxh64(w.encode(), seed=42).intdigest() for w, n in df.items() if max(2, imatch.MIN_SHARE * len(rows)) <= n <= max(2, imatch.MAX_SHARE * len(rows))}
    assert len(lexicon) > 500
    for k, (i, t) in enumerate(rows):
        j, nxt = rows[k - 1]  # the next one in descending order of ids, the last one's being the first
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        r = got[i]
        if split(t):
            assert unpacked(r.fingerprint) == brute_fingerprint(split(t), lexicon), i
        if split(edited):
            assert unpacked(r.edited_fingerprint) == brute_fingerprint(split(edited), lexicon), i
        assert abs(r.near_edited - brute_likeness(unpacked(r.fingerprint), unpacked(r.edited_fingerprint))) < 1e-12
        assert abs(r.near_next - brute_likeness(unpacked(r.fingerprint), unpacked(got[j].fingerprint))) < 1e-12
    assert got[7].fingerprint == got[8].fingerprint and got[8].near_next == 1.0


def test_imatch_long_texts_stay_near(spark):
    # Texts of 300 to 9,000 own words: two thirds are as they were.
    rows = [(i, " ".join(f"own{i}x{k}" for k in range(300 * (1 + i % 4 * 9)))) for i in range(24)]
    got = by_id(imatch.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")))
    near = [r.near_edited for r in got.values()]
    assert min(near) > 0 and np.mean(near) > 0.15 and max(r.near_next for r in got.values()) < 0.1


def test_imatch_group_outside_the_band(spark):
    # Near copies of 120 words that are in every document, so in no band: all words are their terms.
    rng = random.Random(6)
    shared = [f"{rng.getrandbits(40):010x}" for _ in range(120)]
    rows = [(i, " ".join([*shared, f"own{i}"])) for i in range(60)]
    got = by_id(imatch.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")))
    assert min(r.near_edited for r in got.values()) > 0.2 and min(r.near_next for r in got.values()) > 0.8


def test_imatch_adds_terms_up_without_a_sort(spark):
    rows = [(i, i, f"some words {i} and more", f"other words {i}") for i in range(300)]
    texts = spark.createDataFrame(rows, "k1 long, k2 long, text string, edited string")
    found = imatch.fingerprint_pairs(texts, imatch.lexicon(texts, 300))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"HashAggregate\(keys=\[[^]]*cell", plan) and not re.search(r"SortAggregate\(key=\[[^]]*cell", plan)
    assert {r.k1: r.sha for r in found.collect()} == {i: hashlib.sha256(e.encode()).hexdigest() for i, _, _, e in rows}


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.default_vocabulary())
    odd = ["don't I'll ΣΑΣ İx é ﬁ x\x01y a b tab\there 12,5 <|endoftext|> ...", "Ünïcödé, Straße! 漢字😀", "a" * 300]
    own = packing.WordTokenizer(packing.default_vocabulary())
    all_texts = [r[1] or "" for r in rows] + odd
    for t, ids in zip(all_texts, own.encode(all_texts, size=500)):
        assert ids.tolist() == exact.encode(t, add_special_tokens=False).ids
    pieces = packing.pack(docs, length=256, windows=3).collect()
    by = {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
    for i, t, *_ in rows:
        if i is not None:
            ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            at = 0
            for p in sorted(by[i], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
                at += p.length
            assert at == len(ids)
    seqs = {}
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at & (at - 1) == 0 and at <= 256
    assert packing.pack(empty).count() == 0


def test_packing_looks_a_chunk_up_once_a_group():
    class Index(dict):
        asked = 0

        def get(self, *a):
            Index.asked += 1
            return super().get(*a)

        def __getitem__(self, k):
            Index.asked += 1
            return super().__getitem__(k)

    own = packing.WordTokenizer(packing.default_vocabulary())
    first = own.encode(["some words, (again) some\nwords,"] * 500)
    own.index = Index(own.index)
    again = own.encode([None, "some words, (again) some\nwords,"] * 500)
    assert Index.asked <= 10 and all(np.array_equal(again[1], x) for x in [*first, *again[1::2]]) and not any(map(len, again[::2]))


def test_suffix(docs, rows, empty):
    data = {k: (r[1] or "").encode() for k, r in enumerate(rows)}
    seen = Counter(b[p : p + 400] for b in data.values() for p in range(len(b) - 399))
    got = by_id(suffix_dedup.dedup_substrings(docs))
    for k, r in enumerate(rows):
        if r[0] is None:
            continue
        b, m = data[k], np.zeros(len(data[k]) + 1, bool)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                m[p : p + 400] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~m[:-1]])
        assert (got[r[0]].n_bytes, got[r[0]].n_removed, got[r[0]].n_spans, got[r[0]].kept) == (len(b), int(m.sum()), int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum()), kept)
    assert got[0].n_removed == len(data[0]) and got[10].n_removed == 1400 and got[8].n_removed > 0
    assert suffix_dedup.dedup_substrings(empty).count() == 0


def test_suffix_passages(spark):
    rng = random.Random(9)
    own = lambda n: " ".join(f"{rng.getrandbits(24):x}" for _ in range(n))
    p51, p39, p60 = " ".join(f"a{i}" for i in range(51)), " ".join(f"b{i}" for i in range(39)), " ".join(f"c{i}" for i in range(60))
    texts_ = [f"{own(80)} {p51} {own(30)}", f"{own(5)}, {p51.upper()}! {own(200)}", f"{own(70)} {p39} {own(60)}", f"{own(9)} {p39}", f"{p60} {own(3)} {p60}", own(300), own(20), None, "", p60]
    got = by_id(suffix_dedup.dedup_substrings(spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")))
    assert [got[i].n_passages > 0 for i in range(10)] == [True, True, False, False, True, False, False, False, False, True]
    assert got[0].n_removed == got[1].n_removed == 0  # 51 short words are fewer than 400 bytes
    # Cut into parts, a text tells the same marks.
    text = " ".join(own(1) for _ in range(3000)).encode()
    whole = {int(m) for _, ms in suffix_dedup.marks([text]) for m in ms}
    for part in (300, 900, 5000):
        assert {int(m) for _, ms in suffix_dedup.marks([text, b"x"], part) for m in ms} == whole


def test_suffix_texts_in_parts(spark):
    rng = random.Random(12)
    big = "".join(rng.choice("abcdefghij klmnop") for _ in range((1 << 20) + 5000))
    rows = [(1, big), (2, "z" * 50 + big[(1 << 20) - 700 : (1 << 20) + 700] + "y" * 50), (3, big[:10_000])]
    got = by_id(suffix_dedup.dedup_substrings(spark.createDataFrame([*rows, (3, big[:10_000])], "doc_id long, text string")))
    assert got[1].n_removed == 10_000 + 1400 and got[1].n_spans == 2 and got[2].n_removed == 1400 and got[3].n_removed == 10_000


def test_token_counts(docs, rows, empty):
    scores = token_count.zipf_scores(token_count.default_vocabulary())
    low = min(scores.values()) - 10

    def brute(word):
        best = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            best.append(max([(best[e - 1][0] + low, best[e - 1][1] + len(word[e - 1].encode()))] + [(best[s][0] + scores[word[s:e]], best[s][1] + 1) for s in range(max(0, e - 40), e) if word[s:e] in scores]))
        return best[-1][1]

    got = by_id(token_count.count_tokens(docs))
    for i, t, *_ in rows:
        if i is not None and len(t or "") < 2000:
            assert got[i].n_tokens == sum(brute("▁" + w) for w in (t or "").split()), i
    assert token_count.count_tokens(empty).count() == 0


def test_language(spark, empty):
    rng = random.Random(1)
    parts = {"en": ["the", "ing", "tion", "and", "wh", "ed"], "fr": ["eau", "é", "è", "que", "oi", "ment"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(20)), k) for i, k in enumerate(["en", "fr"] * 60)]
    d = spark.createDataFrame([*rows, (500, None, "en"), (501, "123 !!", "fr"), (None, "thething", None)], "doc_id long, text string, lang string")
    out = lang_id.identify(d).collect()
    got = {r.doc_id: r for r in out if r.doc_id is not None}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([got[i].lang_pred == k for i, _, k in rows if got[i].held_out]) > 0.95
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[500].score == 0
    assert lang_id.identify(empty).count() == 0
    net = lang_id.Network(["a", "b"], 3)
    x, y, v = np.random.default_rng(0).integers(0, 256, (6, 4)).astype(np.uint8), np.array([0, 1, 1, 0]), np.ones((6, 4), np.float32)
    v[4:, 1] = 0
    net.p = {k: w.astype(np.float64) for k, w in net.p.items()}
    _, g = net.gradients(x, y, v)
    for k in net.p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        w, eps = net.p[k][at], 1e-2
        net.p[k][at] = w + eps
        up = net.gradients(x, y, v)[0]
        net.p[k][at] = w - eps
        down = net.gradients(x, y, v)[0]
        net.p[k][at] = w
        assert abs((up - down) / (2 * eps) - g[k][at]) < 0.05 * abs(g[k][at]) + 1e-4, k


def test_lm_dictionary_against_brute_force(spark):
    rng = random.Random(2)
    long = "漢字" * 60  # a run without blanks is counted in pieces
    texts_ = [" ".join(rng.choice(["alpha", "be", "gamma", "delta", "epsilon", "zeta"]) for _ in range(rng.randint(0, 40))) + (f"\n{long}" if k % 3 == 0 else "") for k in range(30)]
    docs_ = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    labels_ = spark.createDataFrame([(k, int(k < 10), 0) for k in range(20)] + [(3, 0, 0)], "doc_id long, quality int, toxic int")
    want, good = Counter(), Counter()
    for k, t in enumerate(texts_):
        for w in (w for run in re.split(r"[ \n]+", t) for w in (run[i : i + 48] for i in range(0, len(run), 48)) if len(w) >= 3):
            want[w] += 1
            good[w] += k < 10
    counts = lm_score.word_counts(docs_, labels_)
    assert {r.word: (r.n_all, r.n_good) for r in counts.collect()} == {w: (n, good[w]) for w, n in want.items()}
    for size in (0, 60, 10_000):
        content = lm_score.dictionary(counts, "n_all", size).decode()
        assert len(content.encode()) <= size
        order = sorted((w for w in want if want[w] > 1), key=lambda w: ((want[w] - 1) * len(w.encode()), w))
        taken = content.split()
        assert taken == order[len(order) - len(taken) :] and (size < 10_000 or taken == order)
    assert lm_score.dictionary_bytes(4 * 10**12) == 2 * lm_score.dictionary_bytes(10**12) > 0


def test_lm_score(docs, rows, empty, spark):
    good = spark.createDataFrame([(i, int(i in (0, 1, 2)), 0) for i in range(12)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = by_id(lm_score.lm_score(docs, good))
    assert got[5].score == 0 and got[5].in_domain_bytes == got[5].general_bytes and got[0].in_domain_bytes < got[11].in_domain_bytes
    assert all(-1 <= r.score <= 1 for r in got.values()) and lm_score.lm_score(empty, good).count() == 0
    assert lm_score.lm_score(docs, good.limit(0)).count() == len(rows)
