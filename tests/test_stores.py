"""Files, the index, edits of paged text, commands, addresses, channels and the facade."""

import base64
import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chronofold.functions import keys
from chronofold.operators import chain, commands, folds, index, paged, resolver
from chronofold.operators.collection import TYPES, Collection, Database, signature
from chronofold.sources import codecs, stores
from chronofold.streaming import channels


def test_files(spark, tmp_path):
    (tmp_path / "a" / ".git").mkdir(parents=True)
    (tmp_path / "a/b/c").mkdir(parents=True)
    assert stores.find_root(str(tmp_path / "a/b/c")) == str(tmp_path / "a")
    stores.put(str(tmp_path), {"t/x.md": "Hello World", "t/raw.unknown": b"\x00\x01", "t/plain": "text", "t/o.json": {"a": [1]}})
    assert [stores.detect(str(tmp_path / p))[1] for p in ("t/x.md", "t/raw.unknown", "t/plain", "t", "t/o")] == ["text", "blob", "text", "folder", "json"]
    assert stores.open_store(spark, str(tmp_path / "t/x.md")).first().value == "Hello World"
    assert bytes(stores.open_store(spark, str(tmp_path / "t/raw.unknown")).first().content) == b"\x00\x01"
    assert {r.name for r in stores.children(spark, str(tmp_path / "t")).collect()} == {"x.md", "raw.unknown", "plain", "o.json"}
    assert stores.get(spark, str(tmp_path), "none") is None and stores.get(spark, str(tmp_path), "t").count() == 4
    assert stores.remove(str(tmp_path / "t")) and not stores.remove(str(tmp_path / "t")) and not stores.exists(str(tmp_path), "t")
    stores.put(str(tmp_path), {"DB/M/M.yaml": "a: 1\n", "DB/S/S-INIT.yaml": "", "DB/D.dash": ""})
    assert [stores.find_named(n, str(tmp_path)) and Path(stores.find_named(n, str(tmp_path))).name for n in "MSDX"] == ["M.yaml", "S.yaml", "D.dash", None]
    with pytest.raises(ValueError):
        stores.open_store(spark, str(tmp_path), "nothing")


def test_env_lines_and_projections(spark, tmp_path):
    env = str(tmp_path / ".env")
    assert stores.upsert_env(spark, env, {"A": "1", "B": "two words"}) == {"A": "1", "B": "two words"}
    assert stores.upsert_env(spark, env, {"A": "2"}) == {"A": "2", "B": "two words"} and codecs.read_env(spark, env).first().env == {"A": "2", "B": "two words"}
    assert stores.find_env(codecs.read_env(spark, env), lambda v: v == "2").first().env == {"A": "2"}
    lines = spark.createDataFrame([("p", 0, "start"), ("p", 1, "stop")], "path string, line_no int, line string")
    assert stores.lines_text(stores.set_lines(lines, {1: "go", 3: "end"})).first().value == "start\ngo\n\nend"
    doc = {"a": 1, "b": {"c": "x: y", "d": [1, "two"]}, "e": None, "f": "true"}
    for name in ("p.json", "p.yaml"):
        assert stores.read_projection(stores.write_projection(str(tmp_path / name), doc)) == doc
    assert stores.read_projection(str(tmp_path / "none.json")) == {}
    state = folds.deep_merge(spark.createDataFrame([("l", 0, '{"a":{"b":1,"c":[2]},"d":"x"}')], "log string, seq long, payload string"))
    assert json.loads(stores.nest(state).first().value) == {"a": {"b": 1, "c": [2]}, "d": "x"}


def test_snapshots_do_not_go_back(spark, tmp_path):
    at = str(tmp_path / "snap")
    assert stores.read_snapshot(spark, at) is None
    assert stores.write_snapshot(spark.range(5), at, 5) and not stores.write_snapshot(spark.range(3), at, 3) and stores.write_snapshot(spark.range(9), at, 9)
    assert stores.snapshot_seq(spark, at) == 9 and stores.read_snapshot(spark, at).count() == 9


def test_index(spark):
    rows = spark.createDataFrame([("l", i, json.dumps({"v": i % 70})) for i in range(400)], "log string, seq long, payload string")
    log = chain.write_chain(rows).cache()
    own = index.entries(log)
    levels = index.levels(own).collect()
    assert levels[0].level == 1 and levels[0].closed and sum(r["count"] for r in levels) == 402 == index.total(own).first()["count"]
    lines = index.to_lines(own)
    assert sorted(map(tuple, index.from_lines(lines).collect())) == sorted(map(tuple, own.collect()))
    broken = lines.withColumn("line", F.when(F.col("level") == 3, "3:b:???").otherwise(F.col("line")))
    assert index.from_lines(broken).where("level <> 3").count() == own.where("level <> 3").count()
    assert index.from_lines(lines.where("level > 0")).count() == 0
    taken = {r.bits for r in own.collect()}
    wanted = spark.createDataFrame([("l", format(i, "012b")) for i in range(0, 4096, 97)], "log string, bits string")
    found = {r.bits: r.found for r in index.lookup(own, wanted).collect()}
    assert all(f == next((b[:n] for n in range(1, 13) if b[:n] in taken), None) for b, f in found.items())
    assert index.has(own, wanted.limit(3)).count() == 3 and index.add(own, own).count() == own.count()
    key = log.where("seq = 200").first().key
    assert index.find_in_extent(log, key).first().seq == 200
    assert index.extents(log).agg(F.max("last")).first()[0] == sum(len(r.payload) + len(r.key) + 2 for r in log.collect())


def test_index_lines_of_far_positions(spark):
    """Bitmaps of up to 128 KiB: their work grows with their size, and their bytes are those of a bitmap made by hand."""
    held = {("a", 20): {0, 7, 8, 4095 * 8 + 1, 4096 * 8, (1 << 20) - 1}, ("a", 3): set(range(8)), ("a", 21): {5, (1 << 21) - 1}, ("a", 63): {(1 << 63) - 1, 9}, ("b", 12): {0}, (None, 9): {300, 511}}
    held |= {(f"far{i}", 20): {(1 << 20) - 1 - i, 17 * i} for i in range(6)}
    rows = [(log, level, format(p, f"0{level}b"), p) for (log, level), at in held.items() for p in at]
    own = spark.createDataFrame(rows, "log string, level int, bits string, position long").withColumn("position", F.col("position").cast("decimal(20,0)"))
    began = time.monotonic()
    lines = index.to_lines(own.unionByName(own.limit(3))).collect()
    assert len(lines) == len({log for log, _ in held}) + len(held)
    for log, level, line in lines:
        if level == 0:
            assert line == f"index v1 levels {max(n for other, n in held if other == log)}"
        elif level > 20:
            assert line == f"{level}:s:" + ",".join(map(str, sorted(held[log, level])))
        else:
            bitmap = sum(1 << p for p in held[log, level])
            assert line == f"{level}:b:" + base64.b64encode(bitmap.to_bytes(max(held[log, level]) // 8 + 1, "little")).decode()
    table = spark.createDataFrame(lines, "log string, level int, line string")
    odd = spark.createDataFrame([("b", 4, "4:b:"), ("b", 5, "5:b:?"), ("b", 6, "6:s:x,3"), ("b", 7, None), ("b", 7, "7:b:gA==\r"), ("c", 0, "index v2 levels 3"), ("c", 3, "3:b:AQ=="), ("d", 0, None), ("d", 3, "3:b:AQ==")], table.schema)
    want = sorted(map(str, [*((r[0], r[1], r[2], int(r[3])) for r in rows), ("b", 6, "000011", 3), ("b", 7, "0000111", 7)]))
    assert sorted(str((r.log, r.level, r.bits, int(r.position))) for r in index.from_lines(table.unionByName(odd)).collect()) == want
    assert time.monotonic() - began < 60


def test_key_text_keeps_zeros_within(spark):
    got = spark.createDataFrame([(n,) for n in (0, 1, 63, 64, 4096, 4097, (1 << 62), -1, None)], "n long").select(keys.to_base64(F.col("n"))).collect()
    assert [r[0] for r in got] == ["0", "1", "+", "10", "100", "101", "40000000000", "f" + "+" * 10, None]


def test_verify_takes_any_field_order_and_ranges(spark):
    rows = spark.createDataFrame([("l", i, f'{{"z": {i}, "a": "ü", "n": {{"y": 1.50, "b": null}}}}') for i in range(100)] + [("l", 100, '"just text"'), ("l", 101, "null"), ("l", 102, "[3, 1]")], "log string, seq long, payload string")
    log = chain.write_chain(rows).cache()
    want = chain.verify(log).first()
    assert want.valid and want.length == 105
    assert chain.with_previous(log, span=7).select("seq", "before").exceptAll(chain.with_previous(log).select("seq", "before")).count() == 0
    first = log.orderBy("seq").collect()[2]
    full = int.from_bytes(__import__("hashlib").sha256('{"a":"ü","n":{"b":null,"y":1.5},"z":0}'.encode()).digest()[:8], "big") ^ keys.py_sha64("1")
    assert format(full, "064b").startswith(keys.py_bits(first.key))
    more = chain.extend_chain(log, spark.createDataFrame([("l", 500, '{"x":1}'), ("m", 1, '{"x":1}')], "log string, seq long, payload string"))
    assert chain.verify(log.unionByName(more)).where("log = 'l'").first().valid and more.count() == 2


def test_folds_keep_types_and_depth(spark):
    d = spark.createDataFrame([("l", 0, "k0", '{"a":"null","b":{},"c":"{not json","d":1,"e":"1"}'), ("l", 1, "k1", '"text"')], "log string, seq long, key string, payload string")
    assert {(r.k, r.sub): r.v for r in folds.merge(d).collect()} == {("a", None): '"null"', ("b", None): "{}", ("c", None): '"{not json"', ("d", None): "1", ("e", None): '"1"', ("k1", None): '"text"'}
    deep, want = 1, "1"
    for k in range(12):
        deep = {f"k{k}": deep}
    assert [tuple(r) for r in folds.deep_merge(d.limit(0).unionByName(spark.createDataFrame([("l", 0, "k", json.dumps(deep))], d.schema))).collect()] == [("l", "/".join(f"k{k}" for k in range(11, -1, -1)), want)]
    rows = spark.createDataFrame([("l", i, "k", p) for i, p in enumerate(['{"id":1,"v":1}', '{"v":2}', '{"id":1,"v":3}'])], d.schema)
    assert [tuple(r) for r in folds.upsert_payloads(rows).collect()] == [("l", "1", '{"id":1,"v":3}')]


def test_deep_merge_against_a_fold(spark):
    import random

    rng = random.Random(4)

    def value(depth):
        return rng.choice([None, 1, "s", [1], {}]) if depth == 0 or rng.random() < 0.4 else {rng.choice("abc"): value(depth - 1) for _ in range(rng.randint(1, 2))}

    def fold(state, patch):
        for k, v in patch.items():
            if v is None:
                state.pop(k, None)
            elif isinstance(v, dict):
                state[k] = fold(state[k] if isinstance(state.get(k), dict) else {}, v)
            else:
                state[k] = v
        return state

    def flat(x, path=""):
        return {k2: v2 for k, v in x.items() for k2, v2 in (flat(v, f"{path}{k}/") if isinstance(v, dict) else {path + k: v}).items()}

    logs = {n: [p for p in (value(3) for _ in range(8)) if isinstance(p, dict)] for n in range(60)}
    rows = [(n, i, json.dumps(p)) for n, ps in logs.items() for i, p in enumerate(ps)]
    got = {}
    for r in folds.deep_merge(spark.createDataFrame(rows, "log int, seq long, payload string")).where("v <> '{}'").collect():
        got.setdefault(r.log, {})[r.path] = json.loads(r.v)
    for n, ps in logs.items():
        state = {}
        for p in ps:
            state = fold(state, p)
        assert got.get(n, {}) == flat(state), (n, ps)


def test_paged_text(spark):
    t = paged.PagedText.of(spark.createDataFrame([(1, "a\nb\r\nc\nb\n"), (2, "z")], "doc_id long, text string"))
    one = lambda df, c: {r.doc_id: r[c] for r in df.collect()}
    assert one(t.at(-1), "line") == {1: "b", 2: "z"} and one(t.at(1), "line") == {1: "b"} and t.slice(1, -1).count() == 2
    assert one(t.index_of("b"), "index") == {1: 1, 2: -1} and one(t.index_of("b", last=True), "index")[1] == 3 and one(t.includes("z"), "includes") == {1: False, 2: True}
    assert one(t.some(lambda x: x == "c"), "some")[1] and not one(t.every(lambda x: x == "b"), "every")[1]
    assert one(t.reduce(lambda a, x: F.concat(a, x), F.lit("")), "value")[1] == "abcb" and one(t.reduce(lambda a, x: F.concat(a, x), F.lit(""), right=True), "value")[1] == "bcba"
    assert one(t.reverse().text(), "value")[1] == "b\nc\nb\na" and one(t.set(0, "x").pop().unshift("y").text(), "value")[1] == "y\nx\nb\nc"
    c = t.cursor(1)
    assert one(c.read(2), "line")[1] in "bc" and c.tell() == 3 and c.seek(99).tell() == 4 and c.prev(3).tell() == 1
    c.insert("i", "j").delete(1).replace(1, "r")
    assert c.dirty and one(c.copy.text(), "value")[1] == "a\ni\nj\nr\nb" and one(t.text(), "value")[1] == "a\nb\nc\nb"
    assert one(c.flush().owner.text(), "value")[1] == "a\ni\nj\nr\nb" and not c.dirty
    with pytest.raises(TypeError):
        c.seek("x")
    d = spark.createDataFrame([(1, "a\nb\nc\nd\n")], "doc_id long, text string")
    out = paged.render(d, 4, "clike", "comment").first().value
    assert out.count("//- pagedtext filling\n") == 2 and out.replace("//- pagedtext filling\n", "").startswith("a\nb\nc\nd\n")
    with pytest.raises(ValueError):
        paged.kind_of("none")


def test_cursor_file(spark, tmp_path):
    t = paged.PagedText.of(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"))
    t.cursor(1).write("B").save(str(tmp_path / "c"))
    c = paged.Cursor.load(t, str(tmp_path / "c"))
    assert c.pos == 2 and c.dirty and c.copy.text().first().value == "a\nB" and c.rollback().copy.text().first().value == "a\nb"


def test_commands(tmp_path):
    c, seen = commands.Commands(), []
    c.register("tasks", lambda *a: list(a[:-1]), {"aliases": ["t"]})
    c.register("fail", lambda ctx: 1 / 0)
    c.register("note:get", lambda key, value, get: (key, value))
    c.use(lambda ctx, go: (seen.append(ctx["name"]), go()))
    assert c.run("t", "x")["result"] == ["x"] and c.run("list", "tasks")["result"] == ["list"] and c.run("odd", "tasks more")["result"] == ["odd", "more"]
    assert "division" in c.run("fail")["error"] and c.run("none")["type"] == "error" and c.run("note:get", 5)["result"] == ("note:get", 5)
    assert seen == ["tasks", "tasks", "tasks", "fail", "note:get"]
    (tmp_path / "hello.py").write_text("meta = {'aliases': ['hi']}\ndef run(*args):\n    return 'hello'\n")
    (tmp_path / "hello.help").write_text("says hello")
    assert c.load(str(tmp_path)) == ["hello"] and c.run("hi")["result"] == "hello" and c.registry["hello"].meta["help"] == "says hello"
    (tmp_path / "bad.py").write_text("x = 1\n")
    with pytest.raises(ValueError):
        c.load(str(tmp_path))


def test_addresses(spark):
    cases = ["//DB/name/key", "log#k1", ">a>b", "x/y[main:3]", "#k", "[7]", "plain"]
    got = spark.createDataFrame([(i, a) for i, a in enumerate(cases)], "i int, a string").select("i", resolver.parts(F.col("a")).alias("p")).orderBy("i").collect()
    for a, r in zip(cases, got):
        p = resolver.parse(a)
        assert tuple(r.p) == (p.kind, p.head, p.rest, p.branch, p.turn), a
    assert resolver.normal("../c/./d", "a/b") == "a/c/d" and resolver.normal("/x", "a") == "x"
    r = resolver.Resolver()
    r.define("base", lambda v: {"kind": "base", "n": 1})
    r.define("child:base", lambda v: {"kind": "child", "m": 2})
    assert r.make({"_type": "child", "n": 5}) == {"_type": "child", "n": 5, "kind": "base", "m": 2}
    r.plug_root("DB", lambda a: ("db", a.rest))
    r.plug("num", r"^\d+$", int, lambda a: True)
    assert r.resolve("//DB/x/y") == ("db", "x/y") and r.resolve("12") == 12 and r.resolve("zz") is None and r.exists("12")
    assert json.loads(resolver.to_json({"a": 1, "_x": 2, "b": {"_y": 1}})) == {"a": 1, "b": {}} and resolver.shrink({"_id": 1, "_x": 2, "b": {"_y": 1}, "c": [1]}) == {"_id": 1, "c": [1]}
    t = resolver.tree(spark.createDataFrame([("d", '{"a":{"b":1,"_h":2,"c":[5,6]},"e":{}}')], "doc string, value string"))
    assert {r.path: r.value for r in t.collect()} == {"a": None, "a/b": "1", "a/_h": "2", "a/c": None, "a/c/0": "5", "a/c/1": "6", "e": "{}"}
    assert {r.path for r in resolver.node(t, "a/1").collect()} == {"a/c", "a/c/0", "a/c/1"}
    assert {r.path: r.value for r in resolver.set_value(t, "a/c", "new").collect()}["a/c"] == '"new"'


def test_channels(spark, tmp_path):
    e = spark.createDataFrame([("info", 1, '{"m":1}'), ("error", 2, '{"m":2}'), ("info", 3, '{"m":3}')], "event string, seq long, payload string")
    assert {r.event: r.payload for r in channels.last(e, field="m").collect()} == {"info": "3", "error": "2"}
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    got = {"info": [], "*": [], "on": []}
    channels.fan_out(stream, {"info": lambda b, _: got["info"].extend(r.seq for r in b.collect()), "*": lambda b, _: got["*"].extend(r.seq for r in b.collect())}, str(tmp_path / "c1"), "event", once=True).awaitTermination(60)
    channels.on(stream, "error", lambda b, _: got["on"].extend(r.seq for r in b.collect()), str(tmp_path / "c2"), once=True).awaitTermination(60)
    assert got == {"info": [1, 3], "*": [1, 2, 3], "on": [2]}
    records = spark.createDataFrame([("t", 0, None, "cmd", "u"), ("a", 1, "t", "x", "u"), ("b", 2, "q", "result", "u"), ("c", 3, "a", "result", "u")], "key string, seq long, prev string, type string, source string")
    assert chain.settle_ancestry(records, "t").first().key == "c"


def test_facade(spark, tmp_path):
    rows = spark.createDataFrame([("l", 0, '{"a/b":1}'), ("l", 1, '{"a":{"c":"x"}}')], "log string, seq long, payload string")
    c = Collection.create(rows, "map", str(tmp_path / "log"), "m")
    c.put(spark.createDataFrame([("l", 5, '{"z":true}')], "log string, seq long, payload string"))
    assert Collection.create(rows, "map", str(tmp_path / "log")).size() == 3 and c.verify().first().valid
    assert {r.path: r.v for r in c.get("a").collect()} == {"a/b": "1", "a/c": '"x"'} and json.loads(c.branch().first().value)["z"] is True
    assert c.get("#0").first().key == "0" and c.last().first().seq == 5 and c.scoped("a").get("c").first().v == '"x"' and c.has_children()
    typed = c.put_typed("note", spark.createDataFrame([("l", 6, '{"q":1}')], "log string, seq long, payload string"))
    assert json.loads(typed.log.where("seq = 6").first().payload) == {"q": 1, "type": "note"} and typed.complete(7, "1.1").get("task:1.1/status").first().v == '"done"'
    assert signature("TASKS yaml map odd") == ("TASKS", "yaml", ["map"])
    db = Database(spark, str(tmp_path))
    stores.put(str(tmp_path), {"DB/CONF.yaml": "a: 1\n", "x.txt": "t"})
    assert db.db("x.txt").first().value == "t" and db.db(":memory:") is db and db.types() == sorted(TYPES)
    assert db.make("kv", "k", rows).reducer == "assign" and db.entity("k").size() == 2 and db.agent("z", rows).reducer == "append" and db.exists("k")
    assert db.db("STREAM").reducer == "append" and db.drop("k") and not db.exists("k")
    with pytest.raises(FileNotFoundError):
        db.db("nothing/there")
