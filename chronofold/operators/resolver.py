"""Addresses and node trees: names of nodes, an adjacency table of a JSON tree, types that inherit, views as JSON.

An address is `//branch/rest`, `entity#key`, `>task>path` or a path, perhaps with a qualifier `[branch:turn]`.
A tree is a table (path, parent, name, pos, value): one row a node, value is JSON text of a leaf and null of an inner node.
"""

from __future__ import annotations

import json
import os
import platform
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUALIFIER = r"\[(?:([^\]:]+):)?([0-9]+)\]"


@dataclass(frozen=True)
class Address:
    kind: str  # root, entity, task or path
    head: str  # branch, entity or ''
    rest: str
    branch: str | None = None
    turn: int | None = None


def parse(address: str) -> Address:
    m = re.search(QUALIFIER, address)
    branch, turn = (m[1] or "main", int(m[2])) if m else (None, None)
    text = re.sub(QUALIFIER, "", address)
    if text.startswith("//"):
        head, _, rest = text[2:].partition("/")
        return Address("root", head, rest, branch, turn)
    if text.startswith(">"):
        return Address("task", "", text[1:], branch, turn)
    entity, mark, key = text.rpartition("#")
    return Address("entity", entity, key, branch, turn) if mark else Address("path", "", text, branch, turn)


def parts(address: Column) -> Column:
    """(kind, head, rest, branch, turn) of addresses, as :func:`parse`."""
    turn = F.regexp_extract(address, QUALIFIER, 2)
    clean = F.regexp_replace(address, QUALIFIER, "")
    is_root, is_task, has_key = clean.startswith("//"), clean.startswith(">"), clean.contains("#")
    root = F.regexp_extract_all(clean, F.lit("^//([^/]*)/?(.*)$"), F.lit(1))
    return F.struct(
        F.when(is_root, "root").when(is_task, "task").when(has_key, "entity").otherwise("path").alias("kind"),
        F.when(is_root, root[0]).when(is_task, "").when(has_key, F.regexp_replace(clean, "#[^#]*$", "")).otherwise("").alias("head"),
        F.when(is_root, F.regexp_extract(clean, "^//[^/]*/?(.*)$", 1)).when(is_task, F.substring(clean, 2, 1 << 30)).when(has_key, F.substring_index(clean, "#", -1)).otherwise(clean).alias("rest"),
        F.when(turn != "", F.coalesce(F.nullif(F.regexp_extract(address, QUALIFIER, 1), F.lit("")), F.lit("main"))).alias("branch"),
        F.when(turn != "", turn).cast("int").alias("turn"),
    )


def normal(path: str, at: str = "") -> str:
    """A path from a node, with . and .. resolved."""
    out: list[str] = [] if path.startswith("/") else [s for s in at.split("/") if s]
    for s in path.replace(">", "/").split("/"):
        if s == "..":
            out = out[:-1]
        elif s not in ("", "."):
            out.append(s)
    return "/".join(out)


class Resolver:
    """Root prefixes, plug-ins and types; :meth:`resolve` tries them in that order."""

    def __init__(self):
        self.roots: dict[str, Callable[[Address], object]] = {}
        self.plugs: dict[str, tuple[Callable[[str], bool], Callable[[str], object], Callable[[str], bool] | None]] = {}
        self.types: dict[str, tuple[str | None, Callable[[dict], dict]]] = {}
        self.transformers: dict[str, tuple[Callable, Callable | None]] = {"json": (to_json, from_json), "shrink": (shrink, None)}

    def plug_root(self, prefix: str, factory: Callable[[Address], object]) -> None:
        self.roots[prefix] = factory

    def plug(self, name: str, match: Callable[[str], bool] | str, parse_: Callable[[str], object], exists: Callable[[str], bool] | None = None) -> None:
        self.plugs[name] = (match if callable(match) else re.compile(match).search, parse_, exists)

    def define(self, signature: str, factory: Callable[[dict], dict]) -> None:
        """'name' or 'name:parent'; the factory gives fields, of which those already set stay."""
        name, _, parent = signature.partition(":")
        self.types[name] = (parent or None, factory)

    def transformer(self, name: str, to: Callable, from_: Callable | None = None) -> None:
        self.transformers[name] = (to, from_)

    def lineage(self, name: str) -> list[str]:
        """The type's ancestors, the farthest first, and itself."""
        out: list[str] = []
        while name in self.types and name not in out:
            out.insert(0, name)
            name = self.types[name][0] or ""
        return out

    def make(self, value: dict) -> dict:
        """A node of its `_type`s ('a:b' are several) with the fields that they add; a field's first definition counts."""
        out = dict(value)
        for name in str(value.get("_type") or value.get("type") or "").split(":"):
            for t in self.lineage(name):
                for k, v in (self.types[t][1](out) or {}).items():
                    out.setdefault(k, v)
        return out

    def resolve(self, address: str) -> object | None:
        a = parse(address)
        if a.kind == "root":
            return self.roots[a.head](a) if a.head in self.roots else None
        return next((f(address) for match, f, _ in self.plugs.values() if match(address)), None)

    def exists(self, address: str) -> bool:
        for match, _, exists in self.plugs.values():
            if exists and match(address):
                return bool(exists(address))
        return os.path.exists(address)


def system_tree() -> dict:
    """What is known of the process: environment, folder, id and platform."""
    return {"env": dict(os.environ), "cwd": os.getcwd(), "pid": os.getpid(), "platform": platform.system().lower()}


def tree(docs: DataFrame, doc: str = "doc", value: str = "value") -> DataFrame:
    """(doc, path, parent, name, pos, value) of JSON documents, at any depth."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                stack = [("", None, None, 0, json.loads(text or "null"))]
                while stack:
                    path, parent, name, pos, x = stack.pop()
                    inner = isinstance(x, (dict, list)) and bool(x)
                    if name is not None:
                        rows.append((i, path, parent, name, pos, None if inner else json.dumps(x, ensure_ascii=False)))
                    for k, (n, v) in enumerate(x.items() if isinstance(x, dict) else ((str(j), y) for j, y in enumerate(x))) if inner else ():
                        stack.append((f"{path}/{n}" if path else n, path, n, k, v))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
            at, *rest = (pa.array(c, t) for c, t in zip(columns, types, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *rest], names=["doc", "path", "parent", "name", "pos", "value"])

    return docs.select(doc, value).mapInArrow(run, f"doc {kind}, path string, parent string, name string, pos int, value string")


def node(nodes: DataFrame, path: str, at: str = "") -> DataFrame:
    """A node and all below it; a step that is a number is the nth child whose name is not hidden."""
    want = normal(path, at)
    own = nodes.where((F.col("path") == want) | F.col("path").startswith(want + "/"))
    last = want.rpartition("/")
    if last[2].isdigit() and nodes.where(F.col("path") == want).isEmpty():
        from pyspark.sql import Window

        seen = nodes.where((F.col("parent") == last[0]) & ~F.col("name").startswith("_"))
        n = seen.withColumn("__n", F.row_number().over(Window.partitionBy("doc").orderBy("pos")) - 1).where(F.col("__n") == int(last[2])).select("doc", F.col("path").alias("__p"))
        own = nodes.join(F.broadcast(n), "doc").where((F.col("path") == F.col("__p")) | F.col("path").startswith(F.concat("__p", F.lit("/")))).drop("__p")
    return own


def set_value(nodes: DataFrame, path: str, value: object) -> DataFrame:
    """nodes with a leaf set in every document that has its parent (or at the top); inner nodes on the way are not made."""
    want, text = normal(path), json.dumps(value, ensure_ascii=False)
    parent, _, name = want.rpartition("/")
    last = nodes.where(F.col("parent") == parent).groupBy("doc").agg((F.max("pos") + 1).alias("pos"))
    held = nodes.where((F.col("path") != want) & ~F.col("path").startswith(want + "/"))
    place = nodes.where(F.col("path") == want).select("doc", F.col("pos").alias("own"))
    new = last.join(place, "doc", "left").select("doc", F.lit(want).alias("path"), F.lit(parent).alias("parent"), F.lit(name).alias("name"), F.coalesce("own", "pos").cast("int").alias("pos"), F.lit(text).alias("value"))
    return held.unionByName(new)


def visible(value: dict) -> dict:
    """Without the fields whose names begin with an underscore."""
    return {k: v for k, v in value.items() if not k.startswith("_")}


def hide(fields: Column) -> Column:
    return F.map_filter(fields, lambda k, v: ~k.startswith("_"))


def to_json(value: object) -> str:
    strip = lambda x: {k: strip(v) for k, v in visible(x).items()} if isinstance(x, dict) else [strip(v) for v in x] if isinstance(x, list) else x
    return json.dumps(strip(value), ensure_ascii=False)


def from_json(text: str) -> object:
    return json.loads(text)


def shrink(value: object) -> object:
    """Without hidden fields but _id and _type, and without children that are then empty."""
    if isinstance(value, list):
        return [shrink(v) for v in value]
    if not isinstance(value, dict):
        return value
    kept = {k: shrink(v) for k, v in value.items() if not k.startswith("_") or k in ("_id", "_type")}
    return {k: v for k, v in kept.items() if v not in ({}, [], None)}
