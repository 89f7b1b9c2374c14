"""HTML extraction by consensus host paths.

First pass: each page's containers are scored by the text of their blocks, less that of links; the best
container's generalised path (tags, with class names whose digits are dropped) is the page's vote.  Spark
counts the votes per host.  Second pass: each page is parsed again and its text is taken from the host's
winning path, or, where that path is missing from the page or holds far less than the page's own best
container, from the next path in the host's order and at last from the page's own.  The choice climbs to the containers
around it: an article or main element, or headings and leads that lie directly in a container beside the body.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are left out by tag,
role and the first or last word of a class or id.  Text is joined block by block; character references are decoded, white space (also
no-break spaces) becomes one space.

Plan: two narrow passes over the pages; the votes are pre-aggregated, so a host with a third of all pages is
a few rows in the shuffle.  The table of winners (at most 1 / MIN_SHARE paths a host) is written to the shared
folder; the planner broadcasts it if its size allows and else joins it by host, with skew splitting.

Edge cases.  Null or empty html, or a page without text: ''.  Null url: host ''.  Repeated pages: a row each, a
vote each.  Unclosed, crossed and cut-off markup is read as browsers do for the usual cases (a block closes an
open paragraph, an end tag closes what is open inside it).  Other columns are dropped.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, prepare

MIN_SHARE, ENOUGH = 0.05, 0.5
LONG_PATH, LINKED, EXTRA = 240, 1 / 3, 0.5  # when a path is hashed; what a container may add when the choice climbs to it
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg object canvas textarea title head audio video xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article main section div td body blockquote center".split())
OUT = frozenset("nav header footer aside form button select dialog menu fieldset".split())
CLOSES_P = BLOCK - {"br", "option", "td", "th", "tr", "tbody", "thead", "tfoot"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div main body html blockquote td th aside nav footer header form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead header topbar footer foot sidebar sidenav aside rail ad ads adv advert adverts advertisement advertising adsense adslot adbox banner sponsor sponsored promo promotion"
    " cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist respond reply replies disqus discussion"
    " related recommended recommendations recirc widget widgets toolbar pagination pager search searchbox skip copyright legal disclaimer paywall".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?|"[^"]*"|'[^']*'""")
_READ = frozenset(("class", "id", "role", "hidden", "aria-hidden"))
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "path", "parent", "out", "text", "link")

    def __init__(self, tag, path, parent, out):
        self.tag, self.path, self.parent, self.out = tag, path, parent, out
        self.text = self.link = 0


def attributes(raw: str) -> dict[str, str]:
    """The attributes that are looked at; names within quoted values are no attributes, of repeated ones the first counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw) if raw else ():
        if m[1] and (name := m[1].lower()) in _READ:
            out.setdefault(name, (m[2] or "").strip("\"'"))
    return out


def is_noise(tag: str, attrs: dict[str, str]) -> bool:
    """Left out with all that it holds: by tag, role, or a class or id whose first or last word says so."""
    if tag in OUT or "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES:
        return True
    if not attrs or tag in ("html", "body", "main", "article"):
        return False
    for name in (*attrs.get("class", "").split(), attrs.get("id", "")):
        parts = _PART.findall(name)
        if parts and (parts[0].lower() in NOISE or parts[-1].lower() in NOISE):
            return True
    return False


def step(tag: str, attrs: dict[str, str]) -> str:
    names = sorted({n for c in attrs.get("class", "").lower().split() if (n := re.sub(r"[\d_]+|-+$|^-+", "", c))})
    return tag + "".join(f".{n}" for n in names)


def parse(page: str) -> list[tuple[Node, str, bool]]:
    """The page's text in order: (innermost element, text, whether a block begins before it)."""
    root = Node("", "", None, False)
    stack, out = [root], []
    links, fresh, at, low = 0, True, 0, None

    def add(raw: str) -> None:
        nonlocal fresh
        if not raw:
            return
        node = stack[-1]
        if not node.out:
            text = _html.unescape(raw) if "&" in raw else raw
            n = len(text) if not text.isspace() else 0
            if n:
                node.text += n
                node.link += n if links else 0
            out.append((node, text, fresh))
            fresh = False

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                fresh = True
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth and (tag not in ("b", "i", "a", "span", "em", "strong", "p") or not any(x.tag in SCOPE for x in stack[depth + 1 :])):
                links -= sum(x.tag == "a" for x in stack[depth:])
                del stack[depth:]
            continue
        if tag in BLOCK:
            fresh = True
        if tag in VOID:
            continue
        if tag in RAW:
            if tag == "head":  # what it holds is all left out, but it may lack an end tag
                end = re.compile(r"</head\s*>|<body[\s>]", re.I).search(page, at)
                at = at if end is None else end.end() if end[0][1] == "/" else end.start()
                continue
            if not m[3].rstrip().endswith("/"):
                low = page.lower() if low is None else low
                low_ok = len(low) == len(page)
                end = (low if low_ok else page).find(f"</{tag}", at)
                gt = page.find(">", end) if end >= 0 else -1
                at = gt + 1 if gt >= 0 else len(page)
            continue
        closes = CLOSED_BY.get(tag) or ({"p"} if tag in CLOSES_P else None)
        if closes:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    links -= sum(x.tag == "a" for x in stack[i:])
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE:
                    break
        parent, attrs = stack[-1], attributes(m[3])
        noise = parent.out or is_noise(tag, attrs)
        if tag == "header" and not parent.out and any(x.tag == "article" for x in stack):
            noise = "role" in attrs and attrs["role"].lower() in ROLES  # an article's own heading
        if tag == "form" and parent.tag in ("", "html", "body"):
            noise = parent.out  # some sites wrap the whole page in a form
        path = parent.path
        if tag in SCOPE or tag in BLOCK:
            path = f"{path}>{step(tag, attrs)}"
            if len(path) > LONG_PATH:  # a path's length stays bounded however deep the markup goes
                path = "#" + hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
        stack.append(Node(tag, path, parent, noise))
        if tag == "a":
            links += 1
        if m[3].rstrip().endswith("/") and tag not in BLOCK:
            stack.pop()
            links -= tag == "a"
    add(page[at:])
    return out


def containers(parts: list[tuple[Node, str, bool]]) -> dict[str, float]:
    """Score of each generalised path: text of its blocks less links, a share passed on to what holds it."""
    scores: dict[str, float] = {}
    seen: dict[int, Node] = {id(node): node for node, _, _ in parts}
    for node in seen.values():
        worth = node.text - 2 * node.link
        if not node.text:
            continue
        share, x, depth = 1.0, node, 0
        while x is not None and x.parent is not None:
            if x.tag in CONTAINER:
                scores[x.path] = scores.get(x.path, 0.0) + worth * share * (1.25 if x.tag in ("article", "main") else 1.0)
                depth += 1
                share = 0.7 if depth == 1 else share * 0.7
            x = x.parent
    return {p: s for p, s in scores.items() if s > 0}


def best_path(scores: dict[str, float]) -> str | None:
    return min(scores, key=lambda p: (-scores[p], p)) if scores else None


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


class Under:
    """Which nodes lie within elements of a path (None: all)."""

    def __init__(self, path: str | None):
        self.path, self.known = path, {}

    def __call__(self, node: Node) -> bool:
        if self.path is None:
            return True
        way, x, found = [], node, None
        while found is None:
            if (found := self.known.get(id(x))) is None:
                way.append(x)
                if x.parent is None:
                    found = False
                elif x.path == self.path and x.tag in CONTAINER:
                    found = True
                else:
                    x = x.parent
        for x in way:
            self.known[id(x)] = found
        return found


def container_of(node: Node) -> Node | None:
    while node is not None and node.tag not in CONTAINER:
        node = node.parent
    return node


def text_under(parts: list[tuple[Node, str, bool]], path: str | None, beside: frozenset[str] = frozenset()) -> str:
    """The text within elements of that path (None: all) and what lies directly in containers of the paths beside."""
    blocks: list[str] = []
    held: list[str] = []
    under = Under(path)

    def close() -> None:
        if held and (text := _SPACE.sub(" ", "".join(held)).strip()):
            blocks.append(text)
        held.clear()

    for node, text, fresh in parts:
        if fresh:
            close()
        if under(node) or beside and (c := container_of(node)) is not None and c.path in beside:
            held.append(text)
        elif held:
            close()
    close()
    return " ".join(blocks)


def climb(parts: list[tuple[Node, str, bool]], path: str | None) -> tuple[str | None, frozenset[str]]:
    """(path, beside): an article or main element around the path takes its place, and of other containers around it what
    lies directly in them (headings and leads, not boxes) is added, where that is little beside the body and hardly links."""
    nodes = list({id(node): node for node, _, _ in parts if node.text}.values())
    under, beside = Under(path), set()
    own = [n for n in nodes if under(n)] if path is not None else []
    if not own:
        return path, frozenset()
    size, x = sum(n.text for n in own), own[0]
    while x.path != path or x.tag not in CONTAINER:
        x = x.parent
    while (x := container_of(x.parent)) is not None and x.tag not in ("body", ""):
        if x.path == path:
            continue
        whole = x.tag in ("article", "main")
        wider = Under(x.path) if whole else lambda n, at=x.path: container_of(n) is not None and container_of(n).path == at
        more = [n for n in nodes if not under(n) and wider(n)]
        extra, linked = sum(n.text for n in more), sum(n.link for n in more)
        if linked > LINKED * extra or extra > EXTRA * size:
            break
        if whole:
            path, under, size = x.path, wider, size + extra
        elif more:
            beside.add(x.path)
    return path, frozenset(beside)


def choose(scores: dict[str, float], winners: list[str] | None, enough: float = ENOUGH) -> str | None:
    """The first of the host's winning paths that holds enough of this page, else the page's own best."""
    own = best_path(scores)
    for path in winners or []:
        if path in scores and scores[path] >= enough * scores[own]:
            return path
    return own


def extract_page(page: str | None, winners: list[str] | None = None) -> str:
    parts = parse(page or "")
    return text_under(parts, *climb(parts, choose(containers(parts), winners)))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes, share of the host's votes, rank): every page votes for its best container's path."""
    schema = "host string, path string, weight double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            for page in batch.column("html").to_pylist():
                best.append(best_path(containers(parse(page or ""))))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(best, pa.string()), pa.array([1.0] * len(best), pa.float64())], names=["host", "path", "weight"])

    cast = pages.select(host_of(F.col("url")).alias("host"), F.col("html").alias("html")).mapInArrow(run, schema)
    return cast.where("path is not null").groupBy("host", "path").agg(F.sum("weight").alias("votes"))


def winning_paths(cast: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, winners): the host's paths with at least min_share of its votes, most votes first."""
    total = cast.groupBy("host").agg(F.sum("votes").alias("all_votes"))
    kept = cast.join(total, "host").where(F.col("votes") >= min_share * F.col("all_votes"))
    ranked = kept.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("minus"), "path"))).alias("w"))
    return ranked.select("host", F.transform("w", lambda x: x["path"]).alias("winners"))


def extract(pages: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars per row of pages."""
    prepare(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    cast = materialise(votes(pages), "html-votes")
    winners = materialise(winning_paths(cast, min_share), "html-winners")
    joined = pages.withColumn("host", host_of(F.col("url"))).join(winners, "host", "left").select("page_id", "url", "html", "winners")
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_page(p, w) for p, w in zip(batch.column("html").to_pylist(), batch.column("winners").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)
