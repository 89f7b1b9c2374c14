"""Pinned semantics of folds, chains, codecs, pages, streams and the facade."""

import json

from pyspark.sql import functions as F

from chronofold.functions import keys
from chronofold.operators import chain, folds, paged
from chronofold.operators.collection import Collection, Database
from chronofold.sources import codecs
from chronofold.streaming import tail


def log(spark, *payloads):
    return spark.createDataFrame([("l", i, str(i + 70), p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], "log string, seq long, key string, payload string")


def as_map(df, k="k", v="v"):
    return {r[k]: r[v] for r in df.collect()}


def test_assign_keeps_nulls_and_last_wins(spark):
    assert as_map(folds.assign(log(spark, {"hello": "world"}, {"user": "alice", "x": None}, {"x": 1}, {"hello": None}))) == {"hello": "null", "user": '"alice"', "x": "1"}


def test_merge_one_level(spark):
    out = {(r.k, r.sub): r.v for r in folds.merge(log(spark, {"user": {"name": "Alice", "age": 30}, "gone": 1}, {"user": {"age": 31}, "gone": None}, {"n": 5}, {"n": {"a": 1}})).collect()}
    assert out == {("user", "name"): '"Alice"', ("user", "age"): "31", ("n", "a"): "1"}


def test_deep_merge_paths_and_tombstones(spark):
    out = as_map(folds.deep_merge(log(spark, {"project": "p", "meta": {"version": 1}}, {"meta/author": "kk"}, {"a": {"b": {"c": 1, "d": 2}}}, {"a": {"b": {"c": None}}}, {"s": 1}, {"s": {"t": 2}}, {"u": {"v": 1}}, {"u": None})), "path")
    assert out == {"project": '"p"', "meta/version": "1", "meta/author": '"kk"', "a/b/d": "2", "s/t": "2"}


def test_append_keeps_order_and_custom_reduces(spark):
    d = log(spark, {"msg": "hello"}, {"msg": "world"})
    assert [json.loads(x)["msg"] for x in folds.append(d).first()["records"]] == ["hello", "world"]
    assert folds.custom(d, lambda s, p: {"n": s["n"] + len(p["msg"])}, {"n": 0}, "log string, n long").first()["n"] == 10


def test_base64_round_trip(spark):
    d = spark.range(0, 2000).select("id", keys.to_base64(F.col("id")).alias("b")).select("id", "b", keys.from_base64(F.col("b")).alias("back"))
    got = {r.id: (r.b, r.back) for r in d.collect()}
    assert [got[i][0] for i in (0, 1, 10, 63, 64)] == ["0", "1", "a", "+", "10"]
    assert all(v[1] == k and v[0] == keys.py_base64(k) for k, v in got.items())


def test_allocation_levels_up():
    taken = set()
    assert len({keys.allocate("1011001110", taken) for _ in range(3)}) == 3
    assert len({keys.py_base64(int("1" + b, 2)) for b in ("0", "1", "01", "11", "011", "10", "010", "101")}) == 8


def test_verify_valid_tampered_interleaved(spark):
    rows = spark.createDataFrame([("l", i, json.dumps({"i": i % 7})) for i in range(300)], "log string, seq long, payload string")
    written = chain.write_chain(rows)
    ok = chain.verify(written).first()
    assert ok.valid and ok.length == 302 and ok.duplicates == 0
    bad = chain.verify(written.withColumn("payload", F.when(F.col("seq") == 250, '{"i": "edited"}').otherwise(F.col("payload")))).first()
    assert not bad.valid and bad.failed_at == 250 and bad.failures == 1
    swapped = written.withColumn("seq", F.when(F.col("seq") == 100, 101).when(F.col("seq") == 101, 100).otherwise(F.col("seq")))
    assert not chain.verify(swapped).first().valid
    assert chain.levels(written).agg(F.sum("count")).first()[0] == 302


def test_codecs_hostile_round_trip(spark):
    payloads = [{"s": "a # b #"}, {"q": 'say "x" \\ y'}, {"e": ""}, {"n": -1.5, "t": True, "z": None}, {"deep": {"a": [1, [2]]}}, {"u": "漢字😀"}]
    d = spark.createDataFrame([(f"k{i}", json.dumps(p, ensure_ascii=False, separators=(",", ":"))) for i, p in enumerate(payloads)], "key string, payload string")
    for kind, line in codecs.LINES.items():
        back = codecs.parse_lines(d.select(F.col("key").alias("want"), F.col("payload").alias("p0"), line(F.col("key"), F.col("payload")).alias("value")))
        got = {r["key"]: json.loads(r["payload"]) for r in back.collect()}
        assert got == {f"k{i}": p for i, p in enumerate(payloads)}, kind
    assert codecs.parse_lines(spark.createDataFrame([("junk",), ("",), ('{"manual":"val"}',)], "value string")).select("key", "payload").collect() == [("manual", '"val"')]


def test_env(spark):
    text = '# comment\n\nKEY=val\nFOO="bar baz"\nA=b=c\nKEY=new\n'
    assert spark.createDataFrame([(text,)], "t string").select(codecs.parse_env(F.col("t"))).first()[0] == {"KEY": "new", "FOO": "bar baz", "A": "b=c"}


def test_pages_and_splice(spark):
    d = spark.createDataFrame([(1, "a\nb\nc\nd\n")], "doc_id long, text string")
    pages = paged.pack_pages(d, 4).orderBy("page").collect()
    assert [(r.n_lines, r.n_bytes) for r in pages] == [(2, 4), (2, 4), (1, 1)]
    lines = paged.lines_of(d)
    out = paged.splice(lines, 1, 2, ["x", "y", "z"]).orderBy("line_no")
    assert [r.line for r in out.collect()] == ["a", "x", "y", "z", "d"]


def test_settle_and_descendants(spark):
    c = spark.createDataFrame([("c1", 1), ("c2", 2)], "key string, seq long")
    r = spark.createDataFrame([("r1", 5, "c1", None), ("r2", 4, None, "c1"), ("r0", 0, "c2", None)], "key string, seq long, prev string, ref string")
    assert {x.key: x.result_key for x in chain.settle(c, r).collect()} == {"c1": "r2", "c2": None}
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("z", "y")], "key string, prev string")
    assert {(x.key, x.depth) for x in chain.descendants(links, "a").collect()} == {("b", 1), ("c", 2), ("d", 3)}


def test_collection_and_database(spark, tmp_path):
    rows = spark.createDataFrame([("l", 0, '{"kind":"a","n":1}'), ("l", 1, '{"kind":"b","n":2}'), ("l", 2, '{"kind":"a","n":3}')], "log string, seq long, payload string")
    col = Collection(chain.write_chain(rows))
    assert col.size() == 3 and col.find(F.get_json_object("payload", "$.kind") == "a").count() == 2
    key = col.content().orderBy("seq").first()["key"]
    assert json.loads(col.get("#" + key).first()["payload"])["n"] == 1
    assert col.nth(0).first()["key"] == "0" and json.loads(col.nth(3).first()["payload"])["n"] == 2
    assert as_map(col.state()) == {"kind": '"a"', "n": "3"} and as_map(col.undo().state()) == {"kind": '"b"', "n": "2"}
    assert col.verify().first().valid
    db = Database(spark)
    db.register("tasks", col)
    assert db.resolve("tasks#" + key).count() == 1 and db.resolve("#" + key).count() == 1
    db.query("DROP TABLE IF EXISTS users_t")
    db.query("CREATE TABLE users_t (id INT, name STRING) USING parquet")
    db.insert("users_t", {"id": 1, "name": "Alice"})
    assert db.users_t.collect()[0].name == "Alice" and db.query("SELECT name FROM users_t WHERE id = :i", {"i": 1}).count() == 1
    codecs.write_log(col.log, str(tmp_path / "log"))
    assert codecs.read_log(spark, str(tmp_path / "log/*/*.txt")).count() == 5


def test_stream_equals_batch(spark, tmp_path):
    d = spark.createDataFrame([("l", i, "k", str(i)) for i in range(20)], "log string, seq long, k string, v string")
    d.write.parquet(str(tmp_path / "in"))
    got = []
    q = tail.subscribe(tail.tail(spark, str(tmp_path / "in"), "log string, seq long, k string, v string"), lambda b, _: got.extend(r.seq for r in b.collect()), str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert sorted(got) == list(range(20))
