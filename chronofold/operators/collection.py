"""The facade: a collection wraps a log table; a database opens, names and resolves collections and runs SQL."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.keys import RESERVED
from ..sources import codecs, stores
from . import chain, folds, index


class Collection:
    """A log (log, seq, key, payload) with a reducer; every read is a lazy DataFrame.

    With a path, what is put is appended there (Parquet) and the log is read again from it; without one, the new records
    are joined to the log in the plan.
    """

    def __init__(self, log: DataFrame, reducer: str | Callable[[DataFrame], DataFrame] = "assign", path: str | None = None, name: str | None = None):
        self.log, self.reducer, self.path, self.name = log, reducer, path, name

    @classmethod
    def create(cls, seed: DataFrame, reducer: str = "assign", path: str | None = None, name: str | None = None) -> "Collection":
        """A new log with a genesis pair, seeded with rows (log, seq, payload); at a path that holds a log already, that log."""
        spark = seed.sparkSession
        if path and stores.exists(path):
            return cls(spark.read.parquet(path), reducer, path, name)
        log = chain.write_chain(seed)
        if path:
            log.write.parquet(path)
            log = spark.read.parquet(path)
        return cls(log, reducer, path, name)

    def reseed(self, projection: DataFrame) -> "Collection":
        """Where a log holds no more than its genesis pair, the projection (log, payload) becomes its first record."""
        empty = self.log.groupBy("log").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last")).where("n <= 2")
        return self.put(projection.join(empty, "log").select("log", (F.col("last") + 1).alias("seq"), "payload"))

    def content(self) -> DataFrame:
        return self.log.where(~F.col("key").isin(*RESERVED))

    def records(self) -> DataFrame:
        return self.log.orderBy("log", "seq")

    def load(self) -> DataFrame:
        return self.log.select("key", "payload")

    def state(self) -> DataFrame:
        return (folds.REDUCERS[self.reducer] if isinstance(self.reducer, str) else self.reducer)(self.content())

    def header(self) -> DataFrame:
        return self.log.where(F.col("key") == "0")

    def get(self, address: str = "") -> DataFrame:
        """'' or '#1' the state, '#0' the header, '#n' line n, '#key' a record, 'a/b' (or 'a>b') a path of the state."""
        if address in ("", "#1"):
            return self.state()
        if address.startswith("#"):
            if address[1:].isdigit() and int(address[1:]) < 1 << 31:
                own = self.log.where(F.col("key") == address[1:])
                return own if address == "#0" or not own.isEmpty() else self.nth(int(address[1:]))
            return self.log.where(F.col("key") == address[1:])
        full = address.replace(">", "/")
        head, _, rest = full.partition("/")
        state = self.state()
        if "path" in state.columns:
            return state.where((F.col("path") == full) | F.col("path").startswith(full + "/"))
        found = state.where(F.col("k") == head)
        if not rest:
            return found
        if "sub" in state.columns:
            sub, _, rest = rest.partition("/")
            found = found.where(F.col("sub") == sub)
        path = "$" + "".join(f"['{s}']" for s in rest.split("/")) if rest else "$"
        return found.withColumn("v", F.to_json(F.try_variant_get(F.parse_json("v"), path, "variant"))).where("v is not null")

    def nth(self, n: int) -> DataFrame:
        """The nth line of each log, its header being line 0."""
        w = Window.partitionBy("log").orderBy("seq")
        return self.log.withColumn("__n", F.row_number().over(w) - 1).where(F.col("__n") == n).drop("__n")

    def find_prefix(self, key: str) -> DataFrame:
        """The first record whose full key, in base 64, begins with key."""
        full = keys.to_base64(keys.full_key(F.col("payload"), F.col("before")))
        return chain.with_previous(self.content()).where(full.startswith(key)).orderBy("seq").limit(1).drop("before")

    def find(self, predicate: Column, genesis: bool = False) -> DataFrame:
        return (self.log if genesis else self.content()).where(predicate)

    def verify(self) -> DataFrame:
        return chain.verify(self.log)

    def size(self) -> int:
        return self.content().count()

    def last(self) -> DataFrame:
        """(log, key, seq) of each log's last record."""
        return self.log.groupBy("log").agg(F.max_by("key", "seq").alias("key"), F.max("seq").alias("seq"))

    def since(self, seq: int) -> DataFrame:
        return self.log.where(F.col("seq") > seq)

    def levels(self) -> DataFrame:
        return index.levels(index.entries(self.log))

    def stats(self) -> DataFrame:
        """(log, records, keys, bytes, last)"""
        return self.log.groupBy("log").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("key").alias("keys"), F.sum(F.octet_length("payload")).alias("bytes"), F.max("seq").alias("last"))

    def has_children(self) -> bool:
        return not self.state().isEmpty()

    def branch(self) -> DataFrame:
        """The state as one JSON document a log (an appended state: its records)."""
        state = self.state()
        return state if "records" in state.columns else stores.nest(state)

    def undo(self) -> "Collection":
        """Without each log's last record; at a path this is in the plan only, the file keeps it."""
        last = self.log.groupBy("log").agg(F.max("seq").alias("__last"))
        return Collection(self.log.join(last, "log").where(F.col("seq") < F.col("__last")).drop("__last"), self.reducer, None, self.name)

    def put(self, rows: DataFrame) -> "Collection":
        """The collection with rows (log, seq, payload) behind it, seq being greater than those of the log; keys are
        allocated for them alone."""
        new = chain.extend_chain(self.log, rows)
        if self.path is None:
            return Collection(self.log.unionByName(new), self.reducer, None, self.name)
        new.write.mode("append").parquet(self.path)
        self.log = self.log.sparkSession.read.parquet(self.path)
        return self

    def put_typed(self, kind: str, rows: DataFrame) -> "Collection":
        """Rows whose payload objects get a field type."""
        merged = F.to_json(F.map_concat(F.map_filter(F.from_json("payload", "map<string,variant>"), lambda k, v: k != "type"), F.create_map(F.lit("type"), F.parse_json(F.lit(json.dumps(kind))))))
        return self.put(rows.withColumn("payload", merged))

    def patch(self, seq: int, path: str, value: str) -> "Collection":
        """Every log gets the record {path: value}; value is JSON text."""
        return self.put(self.log.select("log").distinct().select("log", F.lit(seq).cast("long").alias("seq"), F.lit(f"{{{json.dumps(path)}:{value}}}").alias("payload")))

    def complete(self, seq: int, task: str) -> "Collection":
        """A task's status is set to done."""
        return self.patch(seq, f"task:{task}", '{"status":"done"}')

    def scoped(self, name: str) -> "Scoped":
        return Scoped(self, name)

    def close(self, projection: str | None = None) -> None:
        """Write the state as files, one a log, to a folder."""
        if projection:
            self.branch().write.mode("overwrite").json(projection)


class Scoped:
    """A part of a collection whose paths begin with a name."""

    def __init__(self, owner: Collection, name: str):
        self.owner, self.name = owner, name

    def get(self, path: str = "") -> DataFrame:
        return self.owner.get(f"{self.name}/{path}" if path else self.name)

    def set(self, seq: int, path: str, value: str) -> "Scoped":
        self.owner = self.owner.patch(seq, f"{self.name}/{path}", value)
        return self


#: What a collection's class folds by.
TYPES = {"stream": "append", "store": "merge", "kv": "assign", "table": "table", "map": "map", "bloom": "bloom"}
ALIASES = {"STREAM": "stream", "SHELL": "stream", "STATE": "store", "PLANS": "map", "BACKLOG": "map", "MEMORY": "store", "STORE": "store", "TASKS": "map", "DB": "store"}


def signature(text: str) -> tuple[str, str | None, list[str]]:
    """(name, backend, classes) of 'name backend classes'."""
    name, *rest = text.split()
    backends = set(stores.EXTENSIONS.values()) | {"yaml", "dashed"}
    return name, next((p for p in rest if p in backends), None), [p for p in rest if p in TYPES or p in ("sql", "blob", "index")]


class Database:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root, self.collections = spark, root, {}

    @staticmethod
    def extensions() -> list[str]:
        return sorted(stores.EXTENSIONS)

    @staticmethod
    def types() -> list[str]:
        return sorted(TYPES)

    def db(self, target: str, **options) -> "Collection | DataFrame | Database":
        """A target by what it names: ':memory:' or SQL the session, a fixed alias or registered name its collection, a
        named file of the root or a path its reader."""
        if target in (":memory:", "sql"):
            return self
        name, backend, classes = signature(target)
        reducer = TYPES.get(next(iter(classes), ""), options.get("reducer", "assign"))
        if name in self.collections:
            return self.collections[name]
        found = stores.find_named(name, self.root) if self.root and "/" not in name else None
        path = found or (str(Path(self.root) / name) if self.root and not os.path.isabs(name) else name)
        path, kind = stores.detect(path, backend)
        if kind in ("dash", "jsonl") and Path(path).exists():
            return self.open(path, reducer)
        if Path(path).exists():
            return stores.open_store(self.spark, path, kind)
        if name in ALIASES:
            return self.register(name, Collection(self._empty(), TYPES[ALIASES[name]], name=name))
        raise FileNotFoundError(path)

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "log string, seq long, key string, payload string")

    def open(self, path: str, reducer: str = "assign") -> Collection:
        return self.collections.setdefault(path, Collection(codecs.read_log(self.spark, path), reducer, name=path))

    def open_template(self, template: str, reducer: str = "assign", **values: str) -> Collection:
        return self.open(template.format(**values), reducer)

    def make(self, kind: str, name: str, seed: DataFrame | None = None, path: str | None = None) -> Collection:
        """A stream, store, kv, table, map or bloom of that name."""
        if name not in self.collections:
            empty = self._empty()
            made = Collection(empty, TYPES[kind], name=name) if seed is None else Collection.create(seed, TYPES[kind], path, name)
            self.collections[name] = made
        return self.collections[name]

    def agent(self, name: str, seed: DataFrame | None = None) -> Collection:
        return self.make("stream", f"agent/{name}", seed)

    def entity(self, name: str) -> Collection | None:
        return self.collections.get(name)

    def path(self, *names: str) -> str:
        return str(Path(self.root or os.getcwd(), *names))

    def register(self, name: str, collection: Collection) -> Collection:
        self.collections[name] = collection
        return collection

    def resolve(self, address: str) -> DataFrame | None:
        """'entity#key' in that collection; '#key' in any."""
        entity, _, key = address.partition("#")
        names = [entity] if entity else list(self.collections)
        out = None
        for n in names:
            if n in self.collections:
                found = self.collections[n].log.where(F.col("key") == key).withColumn("log", F.col("log").cast("string")).withColumn("entity", F.lit(n))
                out = found if out is None else out.unionByName(found)
        return out

    def entities(self) -> list[dict]:
        return [{"name": n, "size": c.size(), "type": c.reducer} for n, c in self.collections.items()]

    def query(self, sql: str, args: dict | list | None = None) -> DataFrame:
        return self.spark.sql(sql, args=args)

    def table(self, name: str) -> DataFrame | None:
        return self.spark.table(name) if self.spark.catalog.tableExists(name) else None

    def insert(self, name: str, row: dict) -> None:
        cols = ", ".join(f"`{c}`" for c in row)
        self.spark.sql(f"INSERT INTO {name} ({cols}) VALUES ({', '.join(':' + c for c in row)})", args=row)

    def drop(self, name: str) -> bool:
        """Forget a collection, and delete what lies at its path."""
        held = self.collections.pop(name, None)
        return bool(held) and (stores.remove(held.path) if held.path else True)

    def stat(self, name: str) -> os.stat_result | None:
        path = getattr(self.collections.get(name), "path", None) or name
        return os.stat(path) if os.path.exists(path) else None

    def exists(self, name: str) -> bool:
        return name in self.collections or self.stat(name) is not None

    def __getattr__(self, name: str) -> DataFrame:
        found = None if name.startswith("_") else self.table(name)
        if found is None:
            raise AttributeError(name)
        return found
