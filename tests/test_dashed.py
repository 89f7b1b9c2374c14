"""Dashed documents: parsing, views, writing and logs."""

import pytest

from chronofold.sources import dashed
from pyspark.sql import functions as F

TEXT = """PROJECT: Helix Scale #p0
-: {"version":0.1}

-1-sprint#s1: Sprint 1
--1.1-pillar#p1: Pillar 1
---1.1.1-task#t1: Task 1 [high, 1h, open]
----notes: |
  Line 1
  Line 2
---#a1: {"priority":"low"}
---1.1.2-feat: Test Features [critical, 4.5h, wip] { "owner": "jr" } #h9
# a comment
1.1.10: Tenth [medium]
1.1.9-x: Ninth"""


@pytest.fixture(scope="module")
def nodes(spark):
    return dashed.parse(spark.createDataFrame([("d", TEXT), ("e", None), ("f", "-1-a: A\n--1.1-b: B\n---1.1.1-c: null")], "doc string, value string")).cache()


def test_parse(nodes):
    got = {r.path: r for r in nodes.where("doc = 'd'").collect()}
    assert (got["PROJECT"].title, got["PROJECT"].hash, got["meta"].title) == ("Helix Scale", "p0", '{"version": 0.1}')
    task = got["1-sprint>1.1-pillar>1.1.1-task"]
    assert (task.title, task.priority, task.estimate, task.status, task.notes, task.slug, task.hash) == ("Task 1", "low", "1", "open", "Line 1\nLine 2", "task", "t1")
    feat = got["1-sprint>1.1-pillar>1.1.2-feat"]
    assert (feat.priority, feat.estimate, feat.status, feat.extra, feat.hash) == ("critical", "4.5", "wip", '{"owner": "jr"}', "h9")
    assert got["1-sprint>1.1-pillar>1.1.10"].title == "Tenth" and got[""].title == "# a comment"
    assert nodes.where("doc = 'e'").count() == 0 and nodes.where("doc = 'f'").count() == 3


def test_views(nodes, spark):
    own = nodes.where("doc = 'd'")
    order = [r.id for r in dashed.children(own, "1-sprint>1.1-pillar").orderBy("pos").collect()]
    assert order == ["1.1.1-task", "1.1.2-feat", "1.1.9-x", "1.1.10"]
    assert {r.id for r in dashed.tasks(own).collect()} == set(order)
    assert {r.path for r in dashed.unanchored(own).collect()} == {"meta", "1-sprint>1.1-pillar>1.1.9-x", "1-sprint>1.1-pillar>1.1.10"}
    assert dashed.get(own, "1.1.2-feat").first().hash == "h9"
    more = dashed.patch(own, "d", "1-sprint>1.2-new>1.2.1-t", "made")
    assert dashed.get(more, "1-sprint>1.2-new>1.2.1-t").first().title == "made" and dashed.get(more, "1-sprint>1.2-new").count() == 1
    assert dashed.get(dashed.patch(own, "d", "1-sprint", "other"), "1-sprint").first().title == "other"


def test_round_trip(nodes):
    text = {r.doc: r.value for r in dashed.to_text(nodes).collect()}
    assert all(x in text["d"] for x in ("#s1", "#p1", "#t1", "#a1", "#h9", "Line 2"))
    again = dashed.parse(dashed.to_text(nodes))
    columns = ["doc", "path", "title", "hash", "priority", "status", "estimate", "notes", "extra"]
    view = lambda df: sorted(map(tuple, df.where("kind in ('node', 'root', 'meta')").select(columns).collect()), key=str)
    assert view(again) == view(nodes)


def test_columns(spark):
    lines = ["---1.1.2-feat: X [critical, 4.5h, wip] {\"a\": 1} #h9", "meta: {}", "1.1: y", "name: z", "plain", "- x [medium]"]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    got = {r.i: r for r in df.select("i", dashed.line_kind(F.col("line")).alias("k"), dashed.metadata(F.col("line")).alias("m")).collect()}
    assert [got[i].k for i in range(5)] == ["dash", "meta", "num", "root", None]
    assert tuple(got[0].m) == ("critical", "wip", 4.5) and got[5].m.priority == "medium"
    values = ["12", "-1.5", "true", "null", '"q"', "[1,2]", "some text", "1.1.1", ""]
    out = spark.createDataFrame([(v,) for v in values], "v string").select(F.to_json(dashed.typed(F.col("v"))).alias("j")).collect()
    assert [r.j for r in out] == ["12", "-1.5", "true", "null", '"q"', "[1,2]", '"some text"', '"1.1.1"', '""']
    assert spark.range(1).select(dashed.has_annotations(F.lit("a: 1\n-1-x: y")).alias("x"), dashed.has_annotations(F.lit("a: 1\n")).alias("y")).first() == (True, False)


def test_windows(spark):
    rows = [("d", 0, 1, "a"), ("d", 1, 2, "b"), ("d", 2, 3, "c"), ("d", 3, 2, "e"), ("d", 4, 3, "f"), ("d", 5, 1, "g"), ("d", 6, 3, "h")]
    got = dashed.forward_fill(spark.createDataFrame(rows, "doc string, line_no int, depth int, id string"), most=4)
    assert [r.path for r in got.orderBy("line_no").collect()] == ["a", "a>b", "a>b>c", "a>e", "a>e>f", "g", "g>h"]
    text = ["x: 1", "----notes: |", "  one", "  two", "y: 2", "  stray", "-notes#a: |", " last"]
    got = dashed.note_blocks(spark.createDataFrame([("d", i, t) for i, t in enumerate(text)], "doc string, line_no int, line string"))
    assert {r.line_no: r.notes for r in got.collect()} == {1: "one\ntwo", 6: "last"}


def test_log(spark):
    rows = [("l", 0, "{1-a: A} #k0"), ("l", 1, "{1.1-b: B [high]} #k1"), ("l", 2, "{1.1.1-c: line\\ntwo} #k2"), ("l", 3, "noise"), ("m", 0, "{name: 5} #k3")]
    got = [(r.key, r.payload) for r in dashed.parse_log(spark.createDataFrame(rows, "log string, seq int, value string")).orderBy("key").collect()]
    assert got[1:] == [("k1", '{"1-a>1.1-b": {"_val": "B", "priority": "high"}}'), ("k2", '{"1-a>1.1-b>1.1.1-c": "line\\ntwo"}'), ("k3", '{"name": 5}')]
    line = spark.range(1).select(dashed.log_line(F.lit("k"), F.lit("a>b>c>note"), F.lit("x\ny")).alias("v")).first().v
    assert line == "{-note: x\\ny} #k"
