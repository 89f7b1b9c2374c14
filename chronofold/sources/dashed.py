"""Dashed documents: outlines whose lines name a node by dashes or numbers, with tags, a hash anchor and extra fields.

    PROJECT: Name #p0
    -1-sprint#s1: Sprint 1
    --1.1-pillar#p1: Pillar 1
    ---1.1.1-task#t1: Task 1 [high, 1h, open] {"owner": "jr"}
    ----notes: |
      free text

A document becomes rows of NODES, one a node, in order of appearance (``ord``).  Parsing a document is order-dependent
and is done file by file in Arrow batches; all that follows (children, tasks, paths, anchors) is relational.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATOR = ">"
PRIORITIES, STATES = ("critical", "high", "medium", "low"), ("open", "done", "todo", "wip", "active", "blocked")
ATTRIBUTES = frozenset("id slug notes priority estimate status tasks files title spec depends children".split())
NODES = "doc string, ord long, kind string, path string, parent string, id string, depth int, title string, hash string, priority string, status string, estimate string, notes string, slug string, extra string, patches string"
_FIELDS = [f.strip().rsplit(" ", 1)[0] for f in NODES.split(",")]
_ANCHOR = r"(?:#[\w+\-]{0,16})?"
_META = re.compile(rf"(?:-|meta){_ANCHOR}:\s*", re.A)
_DASH = re.compile(rf"(-+)\s*([^#:]*?){_ANCHOR}:\s*(.*)", re.A)
_NUMBER = re.compile(rf"([0-9.]+)([-\w]*){_ANCHOR}:\s*(.*)", re.A)
_ROOT = re.compile(rf"([\w.\->]*?){_ANCHOR}:\s*(.*)", re.A)


# Columns.


def line_kind(line: Column) -> Column:
    """'meta', 'dash', 'num', 'root' or null, by the first recogniser that fits."""
    anchor = r"(#[A-Za-z0-9_+\-]{0,16})?"
    return F.when(line.rlike(rf"^(-|meta){anchor}:"), "meta").when(line.rlike(rf"^-+\s*[^#:]*?{anchor}:"), "dash").when(line.rlike(rf"^[0-9.]+[-\w]*{anchor}:"), "num").when(line.rlike(rf"^[\w.\->]*?{anchor}:"), "root")


def has_annotations(content: Column) -> Column:
    """Whether a text is a dashed document rather than plain YAML."""
    tags = "|".join(("critical", "high", "medium", "low", "open", "done", "wip"))
    return F.coalesce(content.rlike(r"(?m)^-[^ \n]") | content.rlike(r"(?m)^[0-9]+\.[0-9]") | content.rlike(r"#[a-zA-Z0-9_+\-]{2,16}[:\s]") | content.rlike(rf"\[(?:{tags})"), F.lit(False))


def metadata(line: Column) -> Column:
    """(priority, status, estimate) of the tags in brackets at the end of a line; the last of each counts."""
    inside = F.regexp_extract(F.regexp_replace(F.regexp_replace(line, r"\s+#[^\s:]+\s*$", ""), r"\s*\{.*\}\s*$", ""), r"\[([^\]]+)\]\s*$", 1)
    parts = F.transform(F.split(inside, ","), lambda x: F.trim(x))
    tags = [*PRIORITIES, *STATES]
    amount = F.try_element_at(F.filter(parts, lambda p: ~p.isin(*tags) & (p != "") & (p.rlike("[hd]$") | p.try_cast("double").isNotNull())), F.lit(-1))
    pick = lambda names: F.try_element_at(F.filter(parts, lambda p: p.isin(*names)), F.lit(-1))
    return F.struct(pick(PRIORITIES).alias("priority"), pick(STATES).alias("status"), F.coalesce(F.regexp_extract(amount, r"^-?[0-9.]+", 0).try_cast("double")).alias("estimate"))


def typed(text: Column) -> Column:
    """A value's text as a variant: JSON arrays and objects, quoted text, numbers, true, false, null; else a string."""
    quoted = text.rlike(r'^".*"$')
    plain = F.to_json(F.struct(F.when(quoted, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text).alias("v")))
    as_string = F.try_variant_get(F.parse_json(plain), "$.v", "variant")
    number = F.when(text.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), F.try_parse_json(text))
    return F.when(quoted, as_string).otherwise(F.coalesce(F.when(text.rlike(r"^(\[.*\]|\{.*\}|true|false|null)$"), F.try_parse_json(text)), number, as_string))


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("\\n"), F.lit("\n"))


def slug(identifier: Column) -> Column:
    """What follows the number of an id: '1.1.1-task-a' is 'task-a'."""
    return F.regexp_extract(identifier, r"^[0-9.]+-(.*)$", 1)


def number(identifier: Column) -> Column:
    return F.regexp_extract(identifier, r"^([0-9.]+)", 1)


def natural(identifier: Column) -> Column:
    """A sort key by which 1.10 comes behind 1.9: runs of digits as numbers of 20 places."""
    pieces = F.regexp_extract_all(F.coalesce(identifier, F.lit("")), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def forward_fill(lines: DataFrame, depth: str = "depth", identifier: str = "id", most: int = 8, by: str = "doc", order: str = "line_no") -> DataFrame:
    """lines with path: each depth's last id persists until a shallower line comes; one window sort a document."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    place = lambda d: F.last(F.when(F.col(depth) == d, F.struct(F.col(order).alias("o"), F.col(identifier).alias("id"))), ignorenulls=True).over(w)
    out = lines.select("*", *(place(d).alias(f"__d{d}") for d in range(1, most + 1)))
    alive = [F.when((F.col(depth) >= d) & F.col(f"__d{d}").isNotNull() & F.coalesce(*[F.col(f"__d{d}.o") >= F.col(f"__d{u}.o") for u in range(d - 1, 0, -1)], F.lit(True)), F.col(f"__d{d}.id")) for d in range(1, most + 1)]
    return out.withColumn("path", F.array_join(F.array_compact(F.array(*alive)), SEPARATOR)).drop(*(f"__d{d}" for d in range(1, most + 1)))


def note_blocks(lines: DataFrame, by: str = "doc", order: str = "line_no", line: str = "line") -> DataFrame:
    """(doc, line_no, notes): the indented lines behind each 'notes: |' line, up to the first that is not indented."""
    w = Window.partitionBy(by).orderBy(order)
    head = F.col(line).rlike(r"notes[^:]*:\s*\|\s*$")
    part = lines.withColumn("__stop", F.sum(F.when(~F.col(line).rlike(r"^\s+\S") | head, 1).otherwise(0)).over(w)).withColumn("__head", head)
    rows = part.groupBy(by, "__stop").agg(F.max(F.when(F.col("__head"), F.col(order))).alias(order), F.array_sort(F.collect_list(F.when(~F.col("__head"), F.struct(F.col(order).alias("o"), F.ltrim(line).alias("t"))))).alias("rows"))
    return rows.where(F.col(order).isNotNull()).select(by, order, F.array_join(F.transform("rows", lambda r: r["t"]), "\n").alias("notes"))


# Text to rows, in Python.


def flow(text: str):
    """JSON, or a one-line map or list whose names and strings may lack quotes."""
    try:
        return json.loads(text)
    except ValueError:
        bare = re.sub(r'([{,\[]\s*)([A-Za-z_][\w\-/ ]*?)(\s*[:,\]}])', r'\1"\2"\3', text)
        bare = re.sub(r'(:\s*)([A-Za-z_][\w\-/ .]*?)(\s*[,}])', lambda m: m[0] if m[2] in ("true", "false", "null") else f'{m[1]}"{m[2]}"{m[3]}', bare)
        return json.loads(re.sub(r'"(true|false|null)"(?=\s*[,}\]])', r"\1", bare))


def as_number(text: str):
    try:
        x = float(text)
    except ValueError:
        return None
    return None if x != x else int(x) if x.is_integer() and abs(x) < 1 << 53 else x


def cast_value(text: str):
    try:
        if text[:1] == "[" and text[-1:] == "]" or text[:1] == "{" and text[-1:] == "}":
            return flow(text)
    except ValueError:
        return text
    if len(text) > 1 and text[0] == text[-1] == '"':
        return text[1:-1]
    number_ = as_number(text) if text else None
    return number_ if number_ is not None else {"true": True, "false": False, "null": None}.get(text, text)


def parse_tags(inside: str) -> dict:
    out = {}
    for tag in (t.strip() for t in inside.split(",")):
        if tag in PRIORITIES:
            out["priority"] = tag
        elif tag in STATES:
            out["status"] = tag
        elif tag and (tag[-1] in "hd" or as_number(tag) is not None):
            m = re.match(r"-?[\d.]+", tag)
            out["estimate"] = (as_number(m[0]) if m else None) or tag
    return out


def parse_line(line: str) -> dict:
    """id, value, hash, tags and extra of one line."""
    anchor, tags, extra = "", {}, {}
    if m := re.search(r"\s+#([^\s:]+)\s*$", line):
        anchor, line = m[1], line[: m.start()].strip()
    if m := re.search(r"\s*(\{.*\})\s*$", line):
        try:
            extra, line = flow(m[1]), line[: m.start()].strip()
        except ValueError:
            pass
    if (m := re.search(r"\s*\[([^\]]+)\]\s*$", line)) and (tags := parse_tags(m[1])):
        line = line[: m.start()].strip()
    if not anchor and (m := re.search(r"#([a-zA-Z0-9_+\-]{1,16})(?=[: \n]|$)", line)):
        anchor, line = m[1], line[: m.start()] + line[m.end() :]
    name, _, value = line.partition(":")
    return {"id": name.strip(), "value": cast_value(value.strip()), "hash": anchor, "tags": tags, "extra": extra if isinstance(extra, dict) else {}}


class Outline:
    """The stack of ids by depth, which persists from line to line."""

    def __init__(self):
        self.slots: dict[int, str] = {}

    def place(self, line: str, name: str, under_task: bool) -> tuple[str, int, str] | None:
        """(kind, depth, id) of a line, whose slot is set; None if no recogniser fits."""
        if _META.match(line):
            return "meta", 0, "meta"
        if m := _DASH.match(line):
            clean = name.lstrip("-").strip()
            attribute = under_task and (not clean or not clean[0].isdigit())
            depth = 4 if attribute else len(m[1])
            if clean or not under_task:
                self.slots[depth] = clean
            return "dash", depth, clean
        if m := _NUMBER.match(line):
            parts = m[1].split(".")
            for d in range(1, len(parts)):
                above = ".".join(parts[:d])
                if not self.slots.get(d, "").startswith(above) or not self.slots.get(d):
                    self.slots[d] = above
            self.slots[len(parts)] = m[1] + m[2]
            return "num", len(parts), m[1] + m[2]
        return ("root", 0, name) if _ROOT.match(line) else None

    def path(self, depth: int) -> str:
        return SEPARATOR.join(self.slots[d] for d in range(1, depth + 1) if self.slots.get(d) is not None)


def parse_document(text: str) -> list[dict]:
    """Rows of NODES without doc: kinds 'meta', 'root', 'node', 'attribute' and, for lines kept as they are, 'comment' and 'line'."""
    rows: list[dict] = []
    by_path: dict[str, dict] = {}
    outline, task, in_notes = Outline(), None, False

    def add(kind: str, path: str, name: str, depth: int, got: dict | None = None, line: str | None = None) -> dict:
        got = got or {"value": line, "hash": "", "tags": {}, "extra": {}}
        row = {"ord": len(rows), "kind": kind, "path": path, "parent": path.rpartition(SEPARATOR)[0], "id": name, "depth": depth, "value": got["value"], "hash": got["hash"], "notes": "", "slug": "", "patches": [], "extra": dict(got["extra"]), **got["tags"]}
        rows.append(row)
        return row

    def put(path: str, name: str, depth: int, got: dict, kind: str = "node") -> dict:
        steps = path.split(SEPARATOR)
        for d in range(1, len(steps)):
            if (above := SEPARATOR.join(steps[:d])) not in by_path:
                by_path[above] = add("node", above, steps[d - 1], d)
        if path in by_path:  # the last line of a path counts
            rows.remove(by_path[path])
        by_path[path] = row = add(kind, path, name, depth, got)
        return row

    for i, line in enumerate(text.split("\n")):
        if not line:
            continue
        if in_notes and task is not None:
            if line[0].isspace():
                task["notes"] += ("\n" if task["notes"] else "") + line.lstrip()
                continue
            in_notes = False
        got = parse_line(line)
        if line.strip().startswith("#"):
            add("comment", "", str(i), 0, line=line)
            continue
        where = outline.place(line, got["id"], task is not None)
        if where is None:
            add("line", "", str(i), 0, line=line)
            continue
        kind, depth, name = where
        if kind == "meta":
            got["value"] = got["value"] if got["value"] not in ("", None) else got["extra"] or None
            got["extra"] = {}
            add("meta", "meta", "meta", 0, got)
            continue
        if kind == "root":
            add("root", name, name, 0, got)
            continue
        if task is not None and name in ATTRIBUTES:
            if name == "notes" and got["value"] == "|":
                in_notes = True
            elif name in ("priority", "status", "estimate", "notes"):
                task[name] = got["value"]
            else:
                put(f"{task['path']}{SEPARATOR}{name}", name, depth, got, "attribute")
            continue
        if task is not None and not name:  # an anonymous line patches the task
            for k, v in {**got["tags"], **got["extra"]}.items():
                (task if k in ("priority", "status", "estimate") else task["extra"])[k] = v
            if got["hash"]:
                task["patches"].append({"hash": got["hash"], "data": {**got["tags"], **got["extra"]}})
            continue
        path = outline.path(depth)
        if not path:
            continue
        numbered = name[:1].isdigit()
        row = put(path, name, depth, got, "attribute" if task is not None and depth >= 4 else "node")
        if depth in (2, 3) and numbered:
            task, row["slug"] = row, name.partition("-")[2]
        elif task is not None and depth >= 4:
            for k in ("priority", "status", "estimate"):
                if k in got["tags"]:
                    task[k] = got["tags"][k]
            task["extra"].update(got["extra"])
    return rows


def _compact(x) -> str:
    return json.dumps(x, ensure_ascii=False)


def _row(doc: str, k: int, r: dict) -> dict:
    estimate = r.get("estimate")
    return {
        **{c: r.get(c) for c in ("kind", "path", "parent", "id", "depth", "notes", "slug")},
        "doc": doc, "ord": k, "title": r["value"] if isinstance(r["value"], str) else _compact(r["value"]), "hash": r["hash"] or None, "priority": r.get("priority"), "status": r.get("status"),
        "estimate": None if estimate is None else str(estimate), "extra": _compact(r["extra"]) if r["extra"] else None, "patches": _compact(r["patches"]) if r["patches"] else None,
    }


def parse(texts: DataFrame, doc: str = "doc", value: str = "value") -> DataFrame:
    """NODES of each document; texts: one row a document."""
    schema = pa.schema([(c, pa.int64() if c == "ord" else pa.int32() if c == "depth" else pa.string()) for c in _FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([_row(name, k, r) for k, r in enumerate(parse_document(text or ""))], schema=schema)

    return texts.select(F.col(doc).cast("string"), value).mapInArrow(run, NODES)


def read(spark: SparkSession, path: str) -> DataFrame:
    """NODES of dashed files; doc is the file's path."""
    return parse(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), "value"))


# Rows to text.


def format_line(r: dict) -> list[str]:
    """A node's own line, its notes and its anonymous patches."""
    anchor = f"#{r['hash']}" if r["hash"] else ""
    if r["kind"] in ("comment", "line"):
        return [r["title"]]
    if r["kind"] == "meta":
        return [f"meta{anchor}: {r['title']}"]
    if r["kind"] == "root":
        extra = f" {r['extra']}" if r["extra"] else ""
        return [f"{r['id']}: {r['title'] or ''}{extra}{' ' + anchor if anchor else ''}"]
    attribute = r["kind"] == "attribute" or r["depth"] >= 4
    numbered = r["id"][:1].isdigit()
    prefix = "-" if attribute else "" if numbered and "." in r["id"] else "-" * r["depth"]
    estimate = r["estimate"] and (r["estimate"] + "h" if re.fullmatch(r"[\d.]+", r["estimate"]) else r["estimate"])
    tags = [t for t in (r["priority"], estimate, r["status"]) if t]
    line = f"{prefix}{r['id']}{anchor}: {r['title'] or ''}"
    line = line.rstrip(" ") + (f" [{', '.join(tags)}]" if tags else "") + (f" {r['extra']}" if r["extra"] else "")
    out = [line]
    if r["notes"]:
        out += ["----notes: |", *("  " + x for x in r["notes"].split("\n"))]
    # As many dashes as the node has: one alone would be read as the document's meta line.
    out += [f"{'-' * max(2, r['depth'])}#{p['hash']}: {_compact(p['data'])}" for p in json.loads(r["patches"] or "[]")]
    return out


def stringify(rows: Iterable[dict]) -> str:
    """A document's text: meta and root lines first, then the outline with blank lines before its two upper levels."""
    head, body = [], []
    for r in sorted(rows, key=lambda r: (r["kind"] not in ("meta", "root"), r["ord"])):
        if r["kind"] in ("meta", "root"):
            head += format_line(r)
        else:
            if r["kind"] == "node" and r["depth"] <= 2 and (head or body) and (body[-1:] or [None])[0] != "":
                body.append("")
            body += format_line(r)
    return "\n".join([*head, *body]).rstrip()


def to_text(nodes: DataFrame) -> DataFrame:
    """(doc, value): each document's text; a document is one task's rows in order, held while it is written."""
    names = list(_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, held = None, []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if held and r["doc"] != doc:
                    out.append((doc, stringify(held)))
                    held = []
                doc = r["doc"]
                held.append(r)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["doc", "value"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([doc], pa.string()), pa.array([stringify(held)], pa.string())], names=["doc", "value"])

    return nodes.select(*names).repartition("doc").sortWithinPartitions("doc", "ord").mapInArrow(run, "doc string, value string")


# Relational views.


def get(nodes: DataFrame, path: str) -> DataFrame:
    """The node at a path, or with that id where no path fits."""
    tail = F.col("id") == path if SEPARATOR not in path else F.lit(False)
    return nodes.where((F.col("path") == path) | tail)


def children(nodes: DataFrame, path: str | None = None) -> DataFrame:
    """(doc, parent, id, pos) of the nodes below each parent, in natural order of their ids."""
    own = nodes.where(F.col("kind") == "node")
    own = own if path is None else own.where(F.col("parent") == path)
    return own.select("doc", "parent", "path", "id", F.row_number().over(Window.partitionBy("doc", "parent").orderBy(natural(F.col("id")), "id")).alias("pos"))


def tasks(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("kind") == "node") & F.col("id").rlike(r"^\d+\.\d+\.\d+"))


def unanchored(nodes: DataFrame) -> DataFrame:
    """Nodes that have no hash yet: what a log must be seeded with."""
    return nodes.where(F.col("kind").isin("node", "root", "meta") & F.col("hash").isNull())


def seed(nodes: DataFrame) -> DataFrame:
    """(log, seq, payload) patches {path: title} of the nodes without a hash, for chain.extend_chain."""
    return unanchored(nodes).select(F.col("doc").alias("log"), F.col("ord").alias("seq"), F.to_json(F.create_map("path", "title")).alias("payload"))


def patch(nodes: DataFrame, doc: str, path: str, title: str) -> DataFrame:
    """nodes with a node's title set; nodes that lack on the way are made."""
    steps = path.split(SEPARATOR)
    made = [(doc, SEPARATOR.join(steps[:d]), SEPARATOR.join(steps[: d - 1]), steps[d - 1], d, title if d == len(steps) else "") for d in range(1, len(steps) + 1)]
    new = nodes.sparkSession.createDataFrame(made, "doc string, path string, parent string, id string, depth int, title string")
    last = nodes.where(F.col("doc") == doc).agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    lacking = new.join(nodes, ["doc", "path"], "left_anti").join(F.broadcast(last)).withColumn("ord", F.col("last") + F.col("depth")).withColumn("kind", F.lit("node")).drop("last")
    set_ = nodes.withColumn("title", F.when((F.col("doc") == doc) & (F.col("path") == path), F.lit(title)).otherwise(F.col("title")))
    return set_.unionByName(lacking, allowMissingColumns=True)


# Logs of dashed lines: {notation} #key


def log_line(key: Column, path: Column, value: Column) -> Column:
    """The log line that sets a path to a value."""
    steps = F.split(path, SEPARATOR)
    prefix = F.when(F.size(steps) >= 4, "-").otherwise("")
    return F.concat(F.lit("{"), prefix, F.regexp_replace(F.element_at(steps, -1), "^-+", ""), F.lit(": "), escape(F.coalesce(value, F.lit(""))), F.lit("} #"), key)


def parse_log(lines: DataFrame) -> DataFrame:
    """(log, seq, key, payload) of lines (log, seq, value): a line's place may follow from the ones before it in its log."""
    kind = lines.schema["log"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, outline = None, Outline()
        for batch in batches:
            keys, payloads, keep = [], [], []
            for i, (name, line) in enumerate(zip(batch.column("log").to_pylist(), batch.column("value").to_pylist(), strict=True)):
                if name != log:
                    log, outline = name, Outline()
                line = (line or "").strip()
                end = line.rfind("}")
                if not line.startswith("{") or end < 0:
                    continue
                inner, m = line[1:end].strip(), re.match(r"#([a-zA-Z0-9_+\-]+)", line[end + 1 :].strip())
                got = parse_line(inner)
                where = outline.place(inner, got["id"], bool(outline.slots.get(3)))
                value = got["value"].replace("\\n", "\n") if isinstance(got["value"], str) else got["value"]
                rest = {**got["tags"], **got["extra"]}
                if where is None or where[0] in ("meta", "root"):
                    path, value = got["id"], got["extra"] or value
                else:
                    path, value = outline.path(where[1]) or got["id"], {"_val": value, **rest} if rest else value
                keep.append(i)
                keys.append(m[1] if m else None)
                payloads.append(_compact({path: value}))
            rows = batch.select(["log", "seq"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(keys, pa.string()), pa.array(payloads, pa.string())], names=["log", "seq", "key", "payload"])

    dealt = lines.select("log", F.col("seq").cast("long").alias("seq"), "value").repartition("log").sortWithinPartitions("log", "seq")
    return dealt.mapInArrow(run, f"log {kind}, seq long, key string, payload string")
