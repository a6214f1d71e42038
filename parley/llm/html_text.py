"""Main text of web pages, by their marks and a site style tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

#: Elements whose content is no text, or raw text that is never parsed.
RAW = "script|style|noscript|template|textarea|select|iframe|svg|title|object|canvas|math"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUTSIDE = frozenset("head nav header footer aside form menu dialog button".split())
#: Words of a class, id or role that mark what is no main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "sidebar aside complementary footer contentinfo header masthead cookie cookies consent notice notices alert popup modal overlay comment comments "
    "reply replies disqus respond share sharing social related recommended newsletter subscribe signup login search widget toolbar skip hidden".split()
)
#: Words that may stand beside marks in a token ("site-footer", "share-buttons"); with any other word ("has-sidebar", "tag-search") it tells what a page has or is about.
PLAIN = frozenset(
    "area bar block bottom box btn button buttons container content form global group inner item items left links list main outer page panel posts "
    "primary right row secondary section site top wrap wrapper".split()
)
#: Marks that hold over whole articles too, as readers' comments are articles of their own.
COMMENTS = frozenset("comment comments reply replies disqus respond".split())
#: Marks that may as well name a part of a story, and so drop nothing inside an article or main element; the site style tree judges there.
WEAK = frozenset("header masthead banner alert search skip toolbar widget overlay aside complementary contentinfo social signup login".split())
#: Start tags that close an open element of the same kind, up to the nearest container.
SIBLING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table", "tbody", "thead"), "option": ("select",)}
#: What follows a tag's name; a quoted value may hold any character, one whose quote never ends holds none.
ATTRIBUTES = r"""(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>]){ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES})(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
MARKING = frozenset("class id role hidden aria-hidden".split())
#: A node's entropies are taken over this many pages of its host at least; of fewer they say too little, and no branch goes by them.
MIN_PAGES = 5
LOW = 0.3
GAMMA = 0.9
#: Verdicts of more values than this are shuffled, not broadcast.
FEW = 200_000
#: Contributions that a Python worker gathers before it passes them on, besides the last page's.
PIECE = 20_000


@dataclass
class Mark:
    """A mark on an element: it holds unless the element turns out to be or to contain an article or main element."""

    comments: bool
    weak: bool
    holds: bool = True


@dataclass
class Element:
    tag: str
    path: str
    outside: bool  # by tags alone
    main: int  # 0: not in main text, 1: in main, 2: in an article
    marks: tuple[Mark, ...] = ()
    styles: list[str] = field(default_factory=list)


@dataclass
class Block:
    text: str
    path: str
    outside: bool
    main: int
    marks: tuple[Mark, ...] = ()

    @property
    def marked(self) -> bool:
        return any(m.holds for m in self.marks)


def _marks(tag: str, attributes: str) -> tuple[str, Mark | None, bool]:
    """The path step of an element, its mark if it has one, and whether it says it is the main text."""
    name, found, main = "", set(), tag == "main"
    for key, a, b, c in ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), (a or b or c).lower()
        if key not in MARKING:
            continue
        if key in ("hidden", "aria-hidden"):
            if key == "hidden" or value == "true":
                found.add("hidden")
            continue
        for token in value.split():
            words = {w for w in re.split(r"[^a-z0-9]+", token) if w}
            if words <= MARKS | PLAIN:
                found |= words & MARKS
        main |= key == "role" and value == "main"
        if key == "class":
            name = "." + ".".join(sorted(re.split(r"[^a-z0-9]+", value)))
    if not found or tag in ("html", "body", "main"):  # a page's own classes name what it has, not what it is
        return tag + name, None, main
    return tag + name, Mark(not COMMENTS.isdisjoint(found), found <= WEAK), main


def parse(page: str) -> tuple[list[Block], list[tuple[str, str]]]:
    """Blocks in page order, and each element's path with the tags of its children."""
    root = Element("", "", False, 0)
    stack, blocks, styles, parts = [root], [], [], []

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                e = next(x for x in reversed(stack) if x.tag in BLOCK or x is root)
                top = stack[-1]
                blocks.append(Block(text, e.path, top.outside, top.main, top.marks))

    def close(depth: int) -> None:
        flush()
        while len(stack) > depth:
            e = stack.pop()
            styles.append((e.path, " ".join(e.styles)))

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    if tag in BLOCK or any(x.tag in BLOCK for x in stack[depth:]):
                        close(depth)
                    else:
                        for e in stack[depth:]:
                            styles.append((e.path, " ".join(e.styles)))
                        del stack[depth:]
                    break
                if stack[depth].tag in ("article", "main", "body", "table") and tag not in BLOCK:
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        block = tag in BLOCK
        if block:
            flush()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p" or (tag in SIBLING and stack[depth].tag == tag):
                    close(depth)
                    break
                if stack[depth].tag in BLOCK and (tag not in SIBLING or stack[depth].tag in SIBLING[tag]):
                    break
        if tag in VOID:
            continue
        parent = stack[-1]
        step, mark, main = _marks(tag, m[4])
        if mark and parent.main and (mark.weak or tag in HEADINGS and not mark.comments):
            mark = None
        marks = (*parent.marks, mark) if mark else parent.marks
        outside = parent.outside or tag in OUTSIDE
        if (tag == "article" or main) and not outside and parent.main < 2:
            for own in marks:
                own.holds &= own.comments and not main
        if tag == "header" and parent.main and not parent.outside:
            outside = False  # an article's own header, with its title and standfirst
        inside = parent.main
        if not outside:
            inside = 2 if tag == "article" else max(inside, int(main))
        parent.styles.append(step)
        stack.append(Element(tag, f"{parent.path}/{step}" if block else parent.path, outside, inside, marks))
    if at < len(page):
        parts.append(page[at:])
    close(1)
    flush()
    return blocks, styles


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _unmarked(blocks: list[Block]) -> list[Block]:
    """Blocks outside neither by tags nor by marks; marks that leave nothing, or nothing of the article or main element, don't count there."""
    inner = [b for b in blocks if not b.outside]
    kept = [b for b in inner if not b.marked]
    if any(b.main for b in inner) and not any(b.main for b in kept):
        return [b for b in inner if b.main or not b.marked]
    return kept or inner


def _feature(b: Block) -> int:
    return _hash(f"{b.path}\n{b.text}")


def main_text(page: str, low: set[int], repeated: set[int] = frozenset()) -> str:
    """Blocks in article and main elements, without low-importance branches, and the body's other ones where they hold more text.

    `low` are paths, and go outside article and main; inside a block goes only
    if it is in `repeated`, blocks of such paths that other articles of the
    site hold too, and never if those are the most of the text: then the page
    is a near copy.
    """
    blocks = _unmarked(parse(page)[0])
    inside = [b for b in blocks if b.main]
    own = [b for b in inside if _feature(b) not in repeated]
    if 2 * _mass(own) < _mass(inside):
        own = inside
    others = [b for b in blocks if not b.main and _hash(b.path) not in low]
    if inside and _mass(inside) >= _mass(others):
        others = []
    stay = {id(b) for b in own + others}
    kept = [b for b in blocks if id(b) in stay]
    return "\n".join(b.text for b in kept or blocks)


def _mass(blocks: list[Block]) -> int:
    return sum(len(b.text) for b in blocks)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, host, html) -> the page's contribution to its site's style tree; kind 0 content, 1 style, 2 page, 3 block of an article or main element.

    `copy` is the same for pages whose main text is the same. A batch of many
    or long pages is passed on in pieces.
    """
    for batch in batches:
        rows: list[tuple[int, int, int, int, int, int]] = []
        for key, host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            blocks, styles = parse(page.as_py() or "")
            inner = _unmarked(blocks)
            copy = _hash("\n".join(b.text for b in [b for b in inner if b.main] or inner))
            own = {(host, _hash(b.path), 0, _hash(b.text), copy) for b in blocks} | {(host, _hash(p), 1, _hash(s), copy) for p, s in styles}
            own |= {(host, p, 2, 0, copy) for _, p, *_ in own}
            own |= {(host, _hash(b.path), 3, _feature(b), copy) for b in inner if b.main}
            rows.extend((key, *x) for x in own)
            if len(rows) >= PIECE:
                yield _piece(rows)
                rows = []
        yield _piece(rows)


def _piece(rows: list[tuple[int, int, int, int, int, int]]) -> pa.RecordBatch:
    found = np.array(rows, np.int64).reshape(-1, 6)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in range(6)], ["page", "host", "path", "kind", "feature", "copy"])


def site_counts(rows: DataFrame) -> DataFrame:
    """Contributions of pages -> (host, path, kind, feature, n, copies): in how many pages, and in how many different main texts."""
    once = rows.groupBy("host", "path", "kind", "feature", "copy").agg(F.count("*").alias("n"))
    return once.groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"), F.count("*").alias("copies"))


def site_tree(counts: DataFrame) -> DataFrame:
    """Counts -> (host, path, importance, among_texts): a node's entropy of presentation and of content over the site's pages, and over its main texts.

    Both are null where too few pages or texts tell. Merged by counts with
    partial aggregation, so a host with a third of all pages is no hot group.
    """
    sums, importance = [], []
    for of, name in (("n", "importance"), ("copies", "among_texts")):
        n = F.col(of).cast("double")
        sums += [
            F.max(F.when(F.col("kind") == 2, n)).alias(f"{of}_pages"),
            F.sum(F.when(F.col("kind") == 1, n)).alias(f"{of}_styles"),
            F.sum(F.when(F.col("kind") == 1, n * F.log(n))).alias(f"{of}_style_sum"),
            F.sum(F.when(F.col("kind") == 0, n)).alias(f"{of}_contents"),
            F.sum(F.when(F.col("kind") == 0, n * F.log(n))).alias(f"{of}_content_sum"),
        ]
        pages, styles, style_sum, contents, content_sum = (F.col(f"{of}_{k}") for k in ("pages", "styles", "style_sum", "contents", "content_sum"))
        scale = F.log(pages)
        style = F.when(styles > 0, (F.log(styles) - style_sum / styles) / scale).otherwise(F.lit(0.0))
        content = 1 - content_sum / contents / scale
        importance.append(F.when((pages >= MIN_PAGES) & (contents > 0), (1 - GAMMA) * style + GAMMA * content).alias(name))
    return counts.where("kind < 3").groupBy("host", "path").agg(*sums).select("host", "path", *importance)


def _extract(names: list[str], html_at: int, low_at: int, repeated_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(batch.column(html_at), batch.column(low_at), batch.column(repeated_at))
            texts = [main_text(page.as_py() or "", set(low.as_py() or ()), set(repeated.as_py() or ())) for page, low, repeated in found]
            carried = [c for k, c in enumerate(batch.columns) if k not in (html_at, low_at, repeated_at)]
            yield pa.RecordBatch.from_arrays([*carried, pa.array(texts, pa.string())], names)

    return run


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per row: page_id, url, text (empty if none), n_chars.

    Null html is empty; a null or odd url belongs to the host "". Repeated rows
    come back each. An empty table gives an empty result; other columns are not
    read. Branches that the site style tree finds of low importance go, unless
    nothing would stay; a node that fewer than MIN_PAGES pages of the host have
    is never found so. Where a page has article or main elements, its text is
    theirs without marked boilerplate, with the rest of the body only where that
    is longer, and a branch's block inside goes only if other articles of the
    site hold it too.

    Each page gets the verdicts on its own branches and blocks only, so no row
    grows with its host.
    """
    scratch = Scratch(pages.sparkSession, "html")
    host = F.xxhash64(F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)), F.lit("")))
    plain = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("html"))
    plain = plain.withColumn("page", F.xxhash64("host", "html"))  # pages alike in both share their verdicts
    merged = plain.select("page", "host", "html").mapInArrow(_merge, "page long, host long, path long, kind long, feature long, copy long")
    rows = scratch.keep(merged, "rows")
    tree = scratch.keep(site_tree(site_counts(rows.where("kind < 3"))).where(f"importance < {LOW} OR among_texts < {LOW}"), "tree")
    branches, inner = (tree.where(F.col(k) < LOW).select("host", "path") for k in ("importance", "among_texts"))
    shared = site_counts(rows.where("kind = 3")).where("copies > 1").join(inner, ["host", "path"])
    shared = scratch.keep(shared.select("host", "path", "feature"), "shared")
    none = F.lit(None).cast("long")
    low = rows.where("kind = 0").join(branches, ["host", "path"]).select("page", F.col("path").alias("low"), none.alias("repeated"))
    repeated = rows.where("kind = 3").join(shared, ["host", "path", "feature"]).select("page", none.alias("low"), F.col("feature").alias("repeated"))
    verdicts = low.unionByName(repeated).groupBy("page").agg(F.collect_set("low").alias("low"), F.collect_set("repeated").alias("repeated"))
    verdicts = scratch.keep(verdicts, "verdicts")
    size = verdicts.agg(F.sum(F.size("low") + F.size("repeated"))).first()[0] or 0
    joined = plain.join(F.broadcast(verdicts) if size <= FEW else verdicts, "page", "left").select("page_id", "url", "html", "low", "repeated")  # checked; more is shuffled
    schema = T.StructType([joined.schema["page_id"], joined.schema["url"], T.StructField("text", T.StringType())])
    done = joined.mapInArrow(_extract(["page_id", "url", "text"], 2, 3, 4), schema)
    return done.withColumn("n_chars", F.length("text").cast("long"))
