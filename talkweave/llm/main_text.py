"""Operator 2: main text of web pages, by structure and host suffix buckets.

Method.  A page is cut into blocks (runs of text between block-level tags).  Where
the markup says what a block is, that decides: text inside an article or main
element is kept; menus, headers, footers, sidebars, forms, notices, adverts, reader
comments, scripts and styles, by element, role, class or id, go.  A class or id says
something as a whole name or as one made of known words only (site-header, but neither
no-sidebar nor related-work).  What classes, ids and forms say is not believed where no
article is left outside and the element holds an article or most of the page's text.  The other blocks
are judged by repetition within their host: the token streams of all pages of a host
are taken as one text, whose suffixes are dealt into buckets by their first RUN
tokens.  These buckets are the intervals of the host's suffix array with common
prefixes of at least RUN tokens, and longer repeated substrings are chains of such
buckets.  What counts is distinct contents: pages of a host whose open blocks are
equal are one.  A bucket is a template's if it has suffixes of LEAST distinct contents
and of a share SHARE of all that the host has.  A block whose tokens are covered by
such buckets for at least COVERED of its length is boilerplate; other blocks stay.
Where this would leave nothing of a page, the page is a copy, nearly or exactly, of
others, and its blocks stay.  Pages that have an article keep nothing outside it.

So copies of a text never remove it, and hosts of fewer than LEAST distinct contents
lose nothing, as a footer can't be told there from a passage that was copied.

Suffixes inside articles are not judged, because copies of an article on other pages
are repeated substrings too and must stay.

Defined cases.  Null or empty html gives the empty text.  Pages, not page ids, are
compared, so repeated and null page_ids are judged each by its own blocks.  Unclosed elements end with what contains them; an
unterminated tag at the end is dropped; an unterminated comment, script or style runs
to the end.  A null url is a host of its own.  Extra columns are ignored.

Scale.  Pages are cut twice, which costs less than to keep the cut texts; only hashes of undecided blocks are shuffled, those of
equal pages once, and counted by host and hash before the exchange, so a host with very
many pages isn't gathered in one task.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm import text as T
from talkweave.llm.tables import Scratch, small

#: Tokens of a repeated substring at least, and the share of a block's tokens that must be covered.
RUN = 5
COVERED = 0.6
#: Distinct contents of a host that a template's substring is in at least: their number, and their share of all.
LEAST = 3
SHARE = 0.5

# What elements, roles and names of classes and ids mean.
RAW = "script style noscript template textarea title xmp iframe noembed noframes"
SKIPPED = "nav header footer aside form head select button svg math object menu dialog"
SKIPPED_ROLES = "navigation banner contentinfo complementary search form menu menubar dialog alert toolbar"
SKIPPED_NAMES = """
ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices
menu nav navbar navigation breadcrumb breadcrumbs sidebar header footer masthead comment comments reply replies respond disqus
share sharing social related recommended recommendations newsletter subscribe subscription popup modal overlay widget toolbar
login signup pagination pager paywall skip
"""
#: Words that stand beside these names without changing what they mean; others, as in no-sidebar or social-science, do.
NEUTRAL_NAMES = """
site page top bottom left right main primary secondary global local mobile desktop list lists box container wrapper wrap inner outer
area section block group item items bar link links icon icons button buttons form post posts article articles author body content text
row col column slot unit inline float fixed sticky mini small large first last 1 2 3
"""
MAIN = "article main"
MAIN_NAMES = "articlebody article-body post-content entry-content main-content"
BLOCKS = """
address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3
h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul
"""
VOID = "area base br col embed hr img input link meta param source track wbr"

_RAW, _SKIPPED, _ROLES, _NAMES, _NEUTRAL, _MAIN, _MAIN_NAMES, _BLOCKS, _VOID = (frozenset(x.split()) for x in (RAW, SKIPPED, SKIPPED_ROLES, SKIPPED_NAMES, NEUTRAL_NAMES, MAIN, MAIN_NAMES, BLOCKS, VOID))
# Quotes hold a value only after an equals sign, as in browsers; elsewhere they are characters.  All loops are possessive, so that a page takes time in proportion to its length.
_WITHIN = r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+"
_TOKEN = re.compile(
    r"(?P<text>[^<]++)|<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(sorted(_RAW)) + rf")\b{_WITHIN}>.*?(?:</(?P=raw)\s*+>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?:(?P<attributes>{_WITHIN})>|(?P<cut>[^>]*+)>)|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z|(?P<stray><)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|itemprop|aria-hidden)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.IGNORECASE)

KEEP, DROP, OPEN = "keep", "drop", "open"
#: Dropped by class, id or as a form: believed unless it holds what the page is about.
DOUBTED = "doubted"


def _skipped_name(name: str) -> bool:
    """Whether a class or id names something to skip: as a whole, or in words all of which are known."""
    if name in _NAMES:
        return name not in _MAIN_NAMES
    words = [w for w in re.split(r"[-_]+", name) if w]
    return name not in _MAIN_NAMES and not _NAMES.isdisjoint(words) and all(w in _NAMES or w in _NEUTRAL for w in words)


def _meaning(name: str, attributes: str) -> str | None:
    """What an element says of its text: KEEP, DROP, DOUBTED or nothing."""
    if name in _SKIPPED and name != "form":
        return DROP
    means = KEEP if name in _MAIN else DOUBTED if name == "form" else None
    if attributes and not attributes.isspace():
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), (a or b or c).lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in _ROLES:
                return DROP
            if key in ("class", "id"):
                names = value.split()
                if name not in _MAIN and name != "body" and any(map(_skipped_name, names)):
                    means = DOUBTED
                elif not _MAIN_NAMES.isdisjoint(names) and means != DOUBTED:
                    means = KEEP
            if (key == "role" and value in ("main", "article") or key == "itemprop" and value in _MAIN_NAMES) and means != DOUBTED:
                means = KEEP
    return means


def blocks(page: str) -> list[tuple[str, str]]:
    """The (meaning, text) of a page's blocks in order, DROP ones left out."""
    believed: set[int] = set()
    while True:
        found, doubted = _blocks(page, believed)
        if not doubted or any(state == KEEP for state, _ in found):
            return found
        # no article outside: elements that hold one, or most of the text, aren't what their names say
        total = sum(len(text) for _, text in found) + sum(size for size, _ in doubted.values())
        wrong = {at for at, (size, main) in doubted.items() if main or 2 * size > total}
        if not wrong:
            return found
        believed |= wrong


def _blocks(page: str, ignored: set[int]) -> tuple[list[tuple[str, str]], dict[int, tuple[int, bool]]]:
    """The blocks, and of every element that was dropped in doubt, by place, how much text it holds and whether an article; ignored: places of elements whose names and ids say nothing."""
    found: list[tuple[str, str]] = []
    doubted: dict[int, tuple[int, bool]] = {}
    doubt = -1  # place of the element in doubt that is open
    stack: list[tuple[str, str]] = []  # open elements that mean something: name, meaning
    depth: dict[str, int] = {}  # open elements by name since the innermost of these
    depths: list[dict[str, int]] = []
    state, held = OPEN, []

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            found.append((state, text))
        held.clear()

    for m in _TOKEN.finditer(page):
        if m["text"] is not None or m["stray"]:
            if state != DROP:
                held.append(m[0])
            elif doubt >= 0:
                doubted[doubt] = doubted[doubt][0] + len(m[0].strip()), doubted[doubt][1]
            continue
        name = (m["name"] or "").lower()
        if not name:
            continue
        attributes = m["attributes"] or m["cut"] or ""
        if name == "br":
            held.append(" ")
        if name in _BLOCKS:
            flush()
        if m["end"]:
            if depth.get(name):
                depth[name] -= 1
            elif any(n == name for n, _ in stack):
                flush()
                while stack:
                    closed, _ = stack.pop()
                    depth = depths.pop()
                    if closed == name:
                        break
                state = stack[-1][1] if stack else OPEN
                doubt = doubt if state == DROP else -1
            continue
        if name in _VOID or attributes.endswith("/"):
            continue
        if stack and stack[-1][0] == "p" and name in _BLOCKS:  # a paragraph ends where a block begins
            stack.pop()
            depth = depths.pop()
            state = stack[-1][1] if stack else OPEN
            doubt = doubt if state == DROP else -1
        means = _meaning(name, attributes)
        if state == DROP:
            if means == KEEP and doubt >= 0:
                doubted[doubt] = doubted[doubt][0], True
        elif means == DOUBTED:
            means = None if m.start() in ignored else DROP
            if means:
                doubt = m.start()
                doubted[doubt] = 0, False
        elif means == DROP:
            doubt = -1
        if means and state != DROP and means != state:
            flush()
            stack.append((name, means))
            depths.append(depth)
            depth, state = {}, means
        else:
            depth[name] = depth.get(name, 0) + 1
    flush()
    return found, doubted


def _hashes(texts: list[str]) -> list[np.ndarray]:
    """Hashes of the RUN-token suffix heads of each block's tokens (fewer tokens: of them all)."""
    column = pa.array(texts, pa.string())
    data, at = T.buffers(column)
    start, end, counts = T.words(data, at)
    h, number = T.shingles(T.Spans(data).hash(start, end), counts, RUN)
    return np.split(h.view(np.int64), np.cumsum(number)[:-1])


def _cut(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, kept, undecided): kept text blocks, and undecided ones with the hashes of their suffix heads."""
    names = ["page_id", "url", "host", "kept", "undecided", "heads"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in T.pieces(batch, "html"):
                kept, open_, heads = [], [], []
                for page in T.strings(part["html"]).to_pylist():
                    every = blocks(page)
                    main = [t for m, t in every if m == KEEP]
                    rest = [] if main else [t for m, t in every if m == OPEN]
                    kept.append(main)
                    open_.append(rest)
                    heads.append([x.tolist() for x in _hashes(rest)] if rest else [])
                texts, lists = pa.list_(pa.string()), pa.list_(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in names[:3]), pa.array(kept, texts), pa.array(open_, texts), pa.array(heads, lists)], names)

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select("page_id", "url", host.alias("host"), "html")
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, host string, kept array<string>, undecided array<string>, heads array<array<bigint>>"
    return rows.mapInArrow(cut, schema)


def unique_blocks(blocks_: list[str], heads: list[list[int]], repeated: set[int]) -> list[str]:
    """The blocks that repeated substrings cover for less than COVERED of their tokens; all of them if none is left.

    A token is covered if one of the suffix heads that reach it is repeated, so runs of repeated
    heads are the longer repeated substrings, and what is between them is the page's own.
    """
    kept = []
    for text, own in zip(blocks_, heads, strict=True):
        tokens = len(text.split(" "))
        reach = RUN if len(own) > 1 else tokens
        covered = end = 0
        for at, head in enumerate(own):
            if head in repeated:
                covered += at + reach - max(end, at)
                end = at + reach
        if covered < COVERED * tokens:
            kept.append(text)
    return kept or blocks_


def main_texts(pages: DataFrame) -> DataFrame:
    """Every row's (page_id, url, text, n_chars). pages: page_id, url, html."""
    scratch = Scratch(pages.sparkSession, "pages")
    cut = _cut(pages)
    cut = cut.withColumn("content", F.when(F.size("undecided") > 0, F.md5(F.to_json("undecided").cast("binary"))))
    heads = cut.where("content IS NOT NULL").select("host", "content", F.explode(F.array_distinct(F.flatten("heads"))).alias("head")).distinct()
    heads = scratch.save(heads, "heads")
    many = heads.groupBy("host", "head").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    contents = scratch.save(heads.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("all")).where(F.col("all") >= LEAST), "contents")
    repeated = scratch.save(many.join(small(contents, F.length("host")), "host").where(F.col("n") >= SHARE * F.col("all")).select("host", "head"), "repeated")
    found = heads.join(small(repeated, F.length("host")), ["host", "head"]).groupBy("host", "content").agg(F.collect_set("head").alias("repeated"))
    found = scratch.save(found.withColumnsRenamed({"host": "_h", "content": "_c"}), "found")

    @F.arrow_udf("array<string>")
    def unique(undecided: pa.Array, own: pa.Array, told: pa.Array) -> pa.Array:
        rows = zip(undecided.to_pylist(), own.to_pylist(), told.to_pylist(), strict=True)
        return pa.array([unique_blocks(b, h, set(t)) if t else b for b, h, t in rows], pa.list_(pa.string()))

    judged = cut.join(small(found, F.length("_h") + 32 + 8 * F.size("repeated")), (F.col("host") == F.col("_h")) & (F.col("content") == F.col("_c")), "left")
    judged = judged.withColumn("text", F.array_join(F.concat("kept", unique("undecided", "heads", "repeated")), "\n"))
    return scratch.finish(judged.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars")))
