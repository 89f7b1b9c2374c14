"""Paged text: lines packed greedily into pages of bounded bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILL = "//- pagedtext filling"


def lines_of(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line_no, line): carriage returns before a line feed and a last empty line are dropped, filler lines too."""
    parts = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    real = F.filter(parts, lambda x: ~F.ltrim(x).startswith(FILL) & (x != " "))
    return docs.select(F.col(id_column), F.posexplode(real).alias("line_no", "line"))


def pack_pages(docs: DataFrame, page_size: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, page, n_lines, n_bytes): a new page begins when a line and its end would not fit; a line is never cut.

    The running sum with reset is a fold over each text's lines, inside the row: no shuffle.
    """
    parts = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    sizes = F.transform(parts, lambda x: F.octet_length(x).cast("long") + 1)
    start = F.struct(F.array().cast("array<struct<n:bigint,b:bigint>>").alias("done"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("b"))

    def step(a, x):
        full = (a["n"] > 0) & (a["b"] + x > page_size)
        return F.when(full, F.struct(F.concat(a["done"], F.array(F.struct(a["n"].alias("n"), a["b"].alias("b")))).alias("done"), F.lit(1).cast("long").alias("n"), x.alias("b"))).otherwise(
            F.struct(a["done"].alias("done"), (a["n"] + 1).alias("n"), (a["b"] + x).alias("b"))
        )

    pages = F.aggregate(sizes, start, step, lambda a: F.concat(a["done"], F.array(F.struct(a["n"].alias("n"), a["b"].alias("b")))))
    out = docs.select(F.col(id_column), F.posexplode(pages).alias("page", "p"))
    return out.select(id_column, F.col("page").cast("long").alias("page"), F.col("p.n").alias("n_lines"), F.col("p.b").alias("n_bytes"))


def splice(lines: DataFrame, at: int, delete: int, insert: list[str], id_column: str = "doc_id") -> DataFrame:
    """Lines with some deleted and some inserted at a position, renumbered (within each text)."""
    kept = lines.where((F.col("line_no") < at) | (F.col("line_no") >= at + delete)).select(id_column, F.when(F.col("line_no") < at, 0).otherwise(2).alias("part"), F.col("line_no").alias("no"), "line")
    if insert:
        new = F.posexplode(F.array(*(F.lit(x) for x in insert))).alias("no", "line")
        kept = kept.unionByName(lines.select(id_column).distinct().select(id_column, F.lit(1).alias("part"), new))
    w = Window.partitionBy(id_column).orderBy("part", "no")
    return kept.select(id_column, (F.row_number().over(w) - 1).alias("line_no"), "line")


KINDS = {"clike": ("//- pagedtext filling", "//- pagedtext filling\n"), "text": ("#- pagedtext filling", "#- pagedtext filling\n")}


def kind_of(kind: str | tuple | None, filling: str = "ws") -> tuple[str, str]:
    """(prefix of a filler line, what is written between pages): a built-in kind or a pair of one's own."""
    if isinstance(kind, tuple):
        return kind
    if (kind or "text") not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    prefix, comment = KINDS[kind or "text"]
    return prefix, comment if filling == "comment" else " \n"


def render(docs: DataFrame, page_size: int, kind: str | tuple | None = None, filling: str = "ws", id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, value): the text as it lies in a file, filler between its pages; a text is one row."""
    _, fill = kind_of(kind, filling)
    pages = pack_pages(docs, page_size, id_column, text).withColumn("end", F.sum("n_lines").over(Window.partitionBy(id_column).orderBy("page")))
    ends = pages.groupBy(id_column).agg(F.array_sort(F.collect_list("end")).alias("ends"))
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    starts = F.concat(F.array(F.lit(0).cast("long")), F.slice("ends", F.lit(1), F.size("ends") - 1))
    page = F.zip_with(starts, F.col("ends"), lambda a, b: F.concat(F.array_join(F.slice(F.col("__l"), (a + 1).cast("int"), (b - a).cast("int")), "\n"), F.lit("\n")))
    return docs.select(F.col(id_column), lines.alias("__l")).join(ends, id_column).select(id_column, F.array_join(page, fill).alias("value"))


class PagedText:
    """The lines of texts (id, line_no, line) as arrays: one row an id in every result; edits give a new PagedText."""

    def __init__(self, lines: DataFrame, id_column: str = "doc_id"):
        self.lines, self.id = lines.select(id_column, F.col("line_no").cast("long").alias("line_no"), "line"), id_column

    @classmethod
    def of(cls, docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> "PagedText":
        return cls(lines_of(docs, id_column, text), id_column)

    def _agg(self, *columns) -> DataFrame:
        return self.lines.groupBy(self.id).agg(*columns)

    def _numbered(self, lines: DataFrame, *order) -> "PagedText":
        w = Window.partitionBy(self.id).orderBy(*order)
        return PagedText(lines.withColumn("line_no", F.row_number().over(w) - 1), self.id)

    def length(self) -> DataFrame:
        return self._agg(F.count(F.lit(1)).alias("length"))

    def at(self, i: int) -> DataFrame:
        """The line at a position; negative ones count from the end."""
        if i >= 0:
            return self.lines.where(F.col("line_no") == i)
        return self.lines.join(self.length(), self.id).where(F.col("line_no") == F.col("length") + i).drop("length")

    def slice(self, start: int = 0, stop: int | None = None) -> DataFrame:
        n = self.lines.join(self.length(), self.id)
        place = lambda i: F.lit(i) if i >= 0 else F.greatest(F.col("length") + i, F.lit(0))
        return n.where((F.col("line_no") >= place(start)) & (F.col("line_no") < (F.col("length") if stop is None else place(stop)))).drop("length")

    def filter(self, predicate) -> DataFrame:
        return self.lines.where(predicate(F.col("line")))

    def map(self, f) -> DataFrame:
        return self.lines.withColumn("line", f(F.col("line")))

    def for_each(self, f) -> None:
        self.lines.foreach(f)

    def find(self, predicate) -> DataFrame:
        """(id, line, index) of the first line that satisfies it: null and -1 if none does."""
        hit = F.when(predicate(F.col("line")), F.col("line_no"))
        return self._agg(F.min_by("line", hit).alias("line"), F.coalesce(F.min(hit), F.lit(-1)).alias("index"))

    def some(self, predicate) -> DataFrame:
        return self._agg(F.coalesce(F.bool_or(predicate(F.col("line"))), F.lit(False)).alias("some"))

    def every(self, predicate) -> DataFrame:
        return self._agg(F.coalesce(F.bool_and(predicate(F.col("line"))), F.lit(True)).alias("every"))

    def includes(self, line: str) -> DataFrame:
        return self._agg(F.bool_or(F.col("line") == line).alias("includes"))

    def index_of(self, line: str, last: bool = False) -> DataFrame:
        return self._agg(F.coalesce((F.max if last else F.min)(F.when(F.col("line") == line, F.col("line_no"))), F.lit(-1)).alias("index"))

    def reduce(self, f, start, right: bool = False) -> DataFrame:
        """(id, value): f(value, line) over the lines in order; a text's lines are one row."""
        rows = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line")), asc=not right), lambda r: r["line"])
        return self._agg(rows.alias("__r")).select(self.id, F.aggregate("__r", start, f).alias("value"))

    def join(self, separator: str = "\n") -> DataFrame:
        return self._agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), separator).alias("value"))

    def text(self) -> DataFrame:
        return self.join("\n")

    def reverse(self) -> "PagedText":
        return self._numbered(self.lines, F.desc("line_no"))

    def splice(self, at: int, delete: int = 0, insert: list[str] | None = None) -> "PagedText":
        return PagedText(splice(self.lines, at, delete, insert or [], self.id), self.id)

    def set(self, at: int, line: str) -> "PagedText":
        return PagedText(self.lines.withColumn("line", F.when(F.col("line_no") == at, F.lit(line)).otherwise(F.col("line"))), self.id)

    def delete(self, at: int) -> "PagedText":
        return self.splice(at, 1)

    def push(self, *lines: str) -> "PagedText":
        return self.splice((1 << 31) - 1, 0, list(lines))

    def unshift(self, *lines: str) -> "PagedText":
        return self.splice(0, 0, list(lines))

    def shift(self) -> "PagedText":
        return self.splice(0, 1)

    def pop(self) -> "PagedText":
        last = self.length().select(self.id, (F.col("length") - 1).alias("__last"))
        return PagedText(self.lines.join(last, self.id).where(F.col("line_no") < F.col("__last")).drop("__last"), self.id)

    def flush(self, path: str, page_size: int, kind: str | tuple | None = None, filling: str = "ws") -> None:
        """One text file an id, packed in pages with filler between them."""
        render(self.text().withColumnRenamed("value", "text"), page_size, kind, filling, self.id).write.mode("overwrite").partitionBy(self.id).text(path)

    def cursor(self, start: int = 0) -> "Cursor":
        return Cursor(self, start)


class Cursor:
    """A position in a PagedText and an edited copy of it; nothing is written before flush()."""

    def __init__(self, owner: PagedText, start: int = 0, lines: PagedText | None = None):
        self.owner, self.copy, self.dirty = owner, lines or owner, lines is not None
        self.pos = max(0, start)

    def length(self) -> DataFrame:
        return self.copy.length()

    def _end(self) -> int:
        return self.copy.lines.agg(F.max("line_no")).first()[0] + 1 if not self.copy.lines.isEmpty() else 0

    def tell(self) -> int:
        return self.pos

    def seek(self, n: int) -> "Cursor":
        if not isinstance(n, int):
            raise TypeError("a cursor's position is a whole number")
        self.pos = max(0, min(n, self._end()))
        return self

    def next(self, n: int = 1) -> "Cursor":
        return self.seek(self.pos + n)

    def prev(self, n: int = 1) -> "Cursor":
        return self.seek(self.pos - n)

    def peek(self, n: int = 1) -> DataFrame:
        return self.copy.slice(self.pos, self.pos + n)

    def read(self, n: int = 1) -> DataFrame:
        out = self.peek(n)
        self.seek(self.pos + n)
        return out

    def rest(self) -> DataFrame:
        return self.copy.slice(self.pos)

    def _edit(self, delete: int, lines: tuple[str, ...], move: bool = True) -> "Cursor":
        self.copy, self.dirty = self.copy.splice(self.pos, delete, list(lines)), True
        self.pos += len(lines) if move else 0
        return self

    def insert(self, *lines: str) -> "Cursor":
        return self._edit(0, lines)

    def write(self, *lines: str) -> "Cursor":
        return self._edit(len(lines), lines)

    overwrite = write

    def delete(self, n: int = 1) -> "Cursor":
        return self._edit(n, ())

    def replace(self, n: int, *lines: str) -> "Cursor":
        return self._edit(n, lines)

    def rollback(self) -> "Cursor":
        self.copy, self.dirty = self.owner, False
        return self.seek(self.pos)

    def flush(self) -> "Cursor":
        """The owner takes the edited lines."""
        self.owner.lines, self.dirty = self.copy.lines, False
        return self

    def save(self, path: str) -> None:
        """Position and lines as a table beside the text."""
        self.copy.lines.withColumn("pos", F.lit(self.pos)).withColumn("dirty", F.lit(self.dirty)).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, owner: PagedText, path: str) -> "Cursor":
        kind = owner.lines.schema[owner.id].dataType.simpleString()
        held = owner.lines.sparkSession.read.schema(f"{owner.id} {kind}, line_no long, line string, pos int, dirty boolean").json(path)
        first = held.first()
        out = cls(owner, first.pos if first else 0, PagedText(held, owner.id))
        out.dirty = bool(first and first.dirty)
        return out
