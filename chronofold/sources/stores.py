"""Files as stores: text, lines, env, blobs, JSON and YAML documents, folders; where a name is found and which reader it takes.

Readers give DataFrames.  Writers of single small files (projections, env, text) write on the driver, by a temporary
file and a rename, so that a reader sees the old or the new one.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codecs, dashed

#: Extension to reader.
EXTENSIONS = {
    **dict.fromkeys("txt md log sh js ts".split(), "text"),
    **dict.fromkeys("bin exe png jpg jpeg gif pdf zip tar gz".split(), "blob"),
    **dict.fromkeys(("dash", "flow"), "dash"),
    **dict.fromkeys(("yaml", "yml"), "yaml"),
    "jsonl": "jsonl", "json": "json", "env": "env", "lines": "lines", "db": "sql", "sqlite": "sql",
}
ROOT_MARKS = ("MODELS.yaml", ".bot", ".git", "package.json")


def find_root(start: str | None = None, marks: tuple[str, ...] = ROOT_MARKS, most: int = 8) -> str:
    """The nearest folder, start or up to most - 1 above it, that holds a mark; else start."""
    here = Path(start or os.getcwd()).resolve()
    return str(next((d for d in [here, *here.parents][:most] if any((d / m).exists() for m in marks)), here))


def find_named(name: str, root: str) -> str | None:
    """The file of a named collection; where only a seed exists, the file that it will be seeded to."""
    base = Path(root) / "DB"
    for p in (base / name / f"{name}.yaml", base / f"{name}.yaml", base / f"{name}.dash", base / name / f"{name}.dash"):
        if p.exists():
            return str(p)
    return str(base / name / f"{name}.yaml") if (base / name / f"{name}-INIT.yaml").exists() else None


def is_caps(name: Column) -> Column:
    """Whether a folder's name stands for a collection: capitals and underscores only."""
    return name.rlike("^[A-Z_]+$")


def detect(path: str, kind: str | None = None) -> tuple[str, str]:
    """(path, reader): by the kind asked for, the extension (tried one by one if there is none), a NUL byte, or a folder."""
    p = Path(path)
    if "." not in p.name and not p.is_dir():
        p = next((q for e in EXTENSIONS if (q := Path(f"{path}.{e}")).exists()), p)
    found = kind or EXTENSIONS.get(p.suffix[1:].lower())
    if found is None:
        found = "folder" if p.is_dir() else "text"
        if p.is_file():
            with p.open("rb") as f:
                found = "blob" if any(b"\0" in part for part in iter(lambda: f.read(1 << 20), b"")) else "text"
    return str(p), found


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole files as text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def open_store(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A path by the reader that fits it."""
    path, kind = detect(path, kind)
    readers = {
        "text": read_text, "blob": codecs.read_blob, "env": codecs.read_env, "lines": codecs.read_lines, "folder": codecs.list_folder,
        "json": codecs.read_document, "yaml": codecs.read_document, "jsonl": codecs.read_log, "dash": codecs.read_log, "dashed": dashed.read,
    }
    if kind not in readers:
        raise ValueError(f"no reader of kind {kind} for {path}; there are {', '.join(sorted(readers))}")
    return readers[kind](spark, path)


def children(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, folder) of what a folder holds."""
    rows = [(p.name, str(p), p.is_dir()) for p in sorted(Path(path).iterdir())] if Path(path).is_dir() else []
    return spark.createDataFrame(rows, "name string, path string, folder boolean")


def get(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A folder's child: a folder's own listing, a file by its reader, None if there is none."""
    p = Path(folder) / name
    return None if not p.exists() else children(spark, str(p)) if p.is_dir() else open_store(spark, str(p))


def exists(path: str, name: str | None = None) -> bool:
    return (Path(path) / name if name else Path(path)).exists()


def remove(path: str) -> bool:
    """A file or a folder with all that it holds; whether there was one."""
    p = Path(path)
    if not p.exists() and not p.is_symlink():
        return False
    shutil.rmtree(p) if p.is_dir() and not p.is_symlink() else p.unlink()
    return True


def publish(path: str, content: str | bytes) -> str:
    """Write a file whole: a temporary one beside it is renamed over it."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    part = p.with_name(f".{p.name}.{uuid.uuid4().hex}")
    part.write_bytes(content.encode() if isinstance(content, str) else bytes(content))
    os.replace(part, p)
    return str(p)


def put(folder: str, values: dict) -> list[str]:
    """Values by relative path: text and bytes as they are, all else as indented JSON."""
    return [publish(str(Path(folder) / k), v if isinstance(v, (str, bytes)) else json.dumps(v, indent=2, ensure_ascii=False)) for k, v in values.items()]


def set_lines(lines: DataFrame, by_number: dict[int, str]) -> DataFrame:
    """lines (path, line_no, line) with some replaced; numbers behind the end are added, empty ones between."""
    if not by_number:
        return lines
    new = lines.sparkSession.createDataFrame([(int(k), v) for k, v in by_number.items()], "line_no int, new string")
    want = lines.groupBy("path").agg(F.max("line_no").alias("last")).select("path", F.explode(F.sequence(F.lit(0), F.greatest(F.col("last"), F.lit(max(by_number))))).alias("line_no"))
    out = want.join(lines, ["path", "line_no"], "left").join(F.broadcast(new), "line_no", "left")
    return out.select("path", "line_no", F.coalesce("new", "line", F.lit("")).alias("line"))


def lines_text(lines: DataFrame) -> DataFrame:
    """(path, value): lines joined again; only for files that fit a row."""
    return lines.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("value"))


def env_text(values: dict[str, str]) -> str:
    """KEY=VALUE lines; values with blanks, # or quotes are quoted."""
    quote = lambda v: f'"{v}"' if re.search(r"[\s#'\"]", v) else v
    return "".join(f"{k}={quote(str(v))}\n" for k, v in values.items())


def upsert_env(spark: SparkSession, path: str, patch: dict[str, str]) -> dict[str, str]:
    """An env file read anew, merged with patch (last wins) and rewritten."""
    held = dict(codecs.read_env(spark, path).first()["env"]) if Path(path).exists() and Path(path).stat().st_size else {}
    held.update({k: str(v) for k, v in patch.items()})
    publish(path, env_text(held))
    return held


def find_env(env: DataFrame, predicate) -> DataFrame:
    """env with the entries whose value satisfies predicate(value column)."""
    return env.withColumn("env", F.map_filter("env", lambda k, v: predicate(v)))


# A small subset of YAML: nested maps, lists of scalars, comments.


def scalar(text: str):
    quoted = len(text) > 1 and text[0] == text[-1] and text[0] in "\"'"
    if quoted:
        return text[1:-1]
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    return float(text) if re.fullmatch(r"-?\d+\.\d+", text) else {"": None, "true": True, "false": False, "null": None, "~": None}.get(text, text)


def parse_mini_yaml(text: str) -> dict:
    root: dict = {}
    stack: list[tuple[int, dict, str | None]] = [(-1, root, None)]  # indentation, map, the key that waits for what is below it
    for raw in text.split("\n"):
        line = raw.strip()
        if not line or line[0] == "#":
            continue
        indent = len(raw) - len(raw.lstrip())
        if line == "-" or line.startswith("- "):
            while len(stack) > 1 and (stack[-1][2] is None or stack[-1][0] > indent):
                stack.pop()
            _, held, key = stack[-1]
            if key is not None:
                if not isinstance(held.get(key), list):
                    held[key] = []
                held[key].append(scalar(line[1:].strip()))
            continue
        name, colon, rest = line.partition(":")
        if not colon:
            continue
        while len(stack) > 1 and stack[-1][0] >= indent:
            stack.pop()
        _, held, key = stack[-1]
        if key is not None:
            if not isinstance(held.get(key), dict):
                held[key] = {}
            held = held[key]
        held[name.strip()] = scalar(rest.strip()) if rest.strip() else {}
        stack.append((indent, held, name.strip()))
    return root


def mini_yaml(value: dict, indent: int = 0) -> str:
    pad, out = "  " * indent, []
    for k, v in value.items():
        if isinstance(v, dict):
            out.append(f"{pad}{k}:\n{mini_yaml(v, indent + 1)}")
        elif isinstance(v, (list, tuple)):
            out.append(f"{pad}{k}:\n" + "".join(f"{pad}  - {json.dumps(x, ensure_ascii=False) if isinstance(x, (dict, list)) else _plain(x)}\n" for x in v))
        else:
            out.append(f"{pad}{k}: {_plain(v)}\n")
    return "".join(out)


def _plain(v) -> str:
    if isinstance(v, str):
        return f'"{v}"' if re.search(r"[:#{}\[\],&*?|>!%@`]", v) or scalar(v) != v else v
    return {None: "null", True: "true", False: "false"}.get(v, str(v)) if v is None or isinstance(v, bool) else str(v)


# Projections: the state of a log as a file, with the seq that it holds.


def nest(state: DataFrame, separator: str = "/") -> DataFrame:
    """(log, value): state rows (log, path, v) or (log, k[, sub], v) as one JSON document a log."""
    import pyarrow as pa

    steps = F.split("path", re.escape(separator)) if "path" in state.columns else F.array_compact(F.array("k", F.col("sub") if "sub" in state.columns else F.lit(None).cast("string")))
    kind = state.schema["log"].dataType.simpleString()

    def run(batches):
        log, doc, started = None, {}, False
        for batch in batches:
            done = []
            for name, path, v in zip(*(batch.column(c).to_pylist() for c in ("log", "steps", "v")), strict=True):
                if not started or name != log:
                    if started:
                        done.append({"log": log, "value": json.dumps(doc, ensure_ascii=False)})
                    log, doc, started = name, {}, True
                at = doc
                for s in path[:-1]:
                    at = at.setdefault(s, {}) if isinstance(at.get(s, {}), dict) else at.__setitem__(s, {}) or at[s]
                at[path[-1]] = json.loads(v)
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if started:
            yield pa.RecordBatch.from_pylist([{"log": log, "value": json.dumps(doc, ensure_ascii=False)}], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    text = f"log {kind}, value string"
    schema = to_arrow_schema(_parse_datatype_string(text))
    rows = state.select("log", steps.alias("steps"), "v").repartition("log").sortWithinPartitions("log", "steps")
    return rows.mapInArrow(run, text)


WRITERS = {
    "json": lambda doc: json.dumps(doc, indent=2, ensure_ascii=False), "yaml": lambda doc: mini_yaml(doc), "jsonl": lambda doc: "".join(json.dumps({k: v}, ensure_ascii=False) + "\n" for k, v in doc.items()),
    "env": lambda doc: env_text(doc),
}


def write_projection(path: str, doc: dict, kind: str | None = None) -> str:
    """One log's state as a JSON, YAML, JSON-lines or env file."""
    return publish(path, WRITERS[kind or Path(path).suffix[1:].replace("yml", "yaml")](doc))


def read_projection(path: str) -> dict:
    """The state in a file; {} if it is missing, empty or no document."""
    p = Path(path)
    text = p.read_text() if p.exists() else ""
    if p.suffix in (".yaml", ".yml"):
        return parse_mini_yaml(text)
    try:
        doc = json.loads(text or "{}")
    except ValueError:
        return {}
    return doc if isinstance(doc, dict) else {}


def write_snapshot(df: DataFrame, path: str, synced: int) -> bool:
    """A derived table with the last seq that it holds, beside the older ones; a reader takes the newest whole one.

    An older state never hides a newer one: nothing is written if a snapshot of at least synced is there.
    """
    if (newest := snapshot_seq(df.sparkSession, path)) is not None and newest >= synced:
        return False
    df.write.mode("overwrite").parquet(f"{path}/synced={synced}")
    return True


def _snapshots(spark: SparkSession, path: str) -> dict[int, str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    whole = [p for p in found if p.getName().startswith("synced=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return {int(p.getName()[7:]): p.toString() for p in whole}


def snapshot_seq(spark: SparkSession, path: str) -> int | None:
    """What the newest snapshot holds: older is incomplete, not wrong."""
    return max(_snapshots(spark, path), default=None)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    found = _snapshots(spark, path)
    return spark.read.parquet(found[max(found)]) if found else None
