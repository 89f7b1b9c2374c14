"""The pipeline on planted cases, and each stage on empty tables, nulls and extra columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    parts = {"en": ["the", "ing", "tion", "and", "wh", "ed"], "fr": ["eau", "oi", "que", "ment", "eur", "ais"]}
    make = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(n))
    item = " ".join(f"question{i}" for i in range(20))
    rows = [(i, make(("en", "fr")[i % 2], 60), ("en", "fr")[i % 2], "s", 0) for i in range(60)]
    copy = rows[10][1]
    words = rows[20][1].split(" ")
    near = " ".join(["changed", *words[1:]])
    rows += [(100, copy, "en", "s", 0), (101, near, "en", "s", 0), (102, f"{make('en', 400)} {item} {make('en', 400)}", "en", "s", 0), (103, None, "en", "s", 0), (104, "12 34 !!", None, "s", 0)]
    line = "this very line is held by many documents"
    rows += [(k, f"{make('en', 50)}\n{line}", "en", "s", 0) for k in (110, 111, 112)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.char_length("text").cast("long")).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at), dict((r[0], r[1]) for r in rows)


def test_stages(spark, folder):
    at, texts = folder
    docs = spark.read.parquet(f"{at}/documents.parquet").withColumn("extra", F.lit(1)).withColumn("hit_words", F.lit("clash"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, at), f"test-{name}")
        assert docs.columns == corpus_pipeline.COLUMNS
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert set(texts) - set(seen["language_id"]) == {103, 104}
    assert seen["line_dedup"][110].text == texts[110].split("\n")[0] and seen["line_dedup"][112].text == texts[112] and seen["line_dedup"][110].n_chars == len(seen["line_dedup"][110].text)
    assert set(seen["line_dedup"]) - set(seen["near_dedup"]) == {100, 101}
    assert set(seen["near_dedup"]) - set(seen["decontamination"]) == {102}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, at).collect()
    assert {p.doc_id for p in pieces} == set(seen["decontamination"])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_empty(spark, folder):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder[0]).count() == 0
