"""Markdown documents to blocks, inline HTML, XHTML and book rows (H)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkweave import schemas as S
from talkweave.functions import text as X

#: Private-use marks around the number of a link while other rules run.
OPEN, CLOSE = "\ue000", "\ue001"

# The accepted Markdown syntax, line ends included.
LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
HEADING, RULE = r"(?U)^#{1,6}\s+", r"(?U)^\s*([-*_])\1{2,}\s*$"
BOLD, ITALIC = r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"(?<!\*)(\*|_)(?=\S)(.+?)(?<=\S)\1(?!\*)"
CODE, LINK = "`([^`]+)`", r"(\[.*?\]\(.*?\))"
# The look of code, and the envelope of a document with its style sheet.
CODE_STYLE = "background:#f4f4f4;padding:0 2px"
STYLES = """
body{font-family:serif;line-height:1.45;font-size:0.95em}
h1,h2,h3{margin:0.6em 0 0.35em; padding:0}
p{margin:0.35em 0}
ul{margin:0.25em 0 0.35em 1.1em; padding:0}
li{margin:0.15em 0}
blockquote{margin:0.5em 0; padding-left:1em; border-left:3px solid #ccc; color:#666; font-style:italic}
hr{border:0; border-top:1px solid #ddd; margin:1em 0}
"""
PROLOGUE = "<?xml version='1.0' encoding='utf-8'?>\n<!DOCTYPE html>\n"


def corrected_markdown(title: Column, author: Column, body: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit(f"\n\n**{X.AUTHOR_LABEL}**: "), author, F.lit("\n\n---\n\n"), body)


def final_markdown(title: Column, author: Column, summary: Column, body: Column) -> Column:
    return F.concat(corrected_markdown(title, author, summary), F.lit(f"\n\n---\n\n## {X.FULL_TEXT_HEADING}\n\n"), body)


def inline_html(text: Column) -> Column:
    """Escaped text with code, bold, italic and links."""
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return X.bound(F.regexp_replace(text, CODE, f'<code style="{CODE_STYLE}"> $1 </code>'), _linked)


def _styled(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, BOLD, "<b>$2</b>"), ITALIC, "<i>$2</i>")


def _linked(text: Column) -> Column:
    """Styles outside links; the links themselves are put aside under their numbers meanwhile."""
    mark = lambda n: F.concat(F.lit(OPEN), n.cast("string"), F.lit(CLOSE))
    anchor = lambda link: F.concat(F.lit('<a href="'), F.regexp_extract(link, r"\]\((.*?)\)$", 1), F.lit('">'), F.regexp_extract(link, r"^\[(.*?)\]", 1), F.lit("</a>"))

    def around(links: Column) -> Column:
        count = lambda t: F.struct(t.alias("t"), F.lit(0).alias("n"))
        aside = F.aggregate(links, count(text), lambda a, link: F.struct(F.regexp_replace(a["t"], X.quoted(link), mark(a["n"])).alias("t"), (a["n"] + 1).alias("n")))["t"]
        return F.aggregate(links, count(_styled(aside)), lambda a, link: F.struct(F.replace(a["t"], mark(a["n"]), anchor(link)).alias("t"), (a["n"] + 1).alias("n")))["t"]

    return X.bound(F.regexp_extract_all(text, F.lit(LINK), 1), lambda links: F.when(F.size(links) == 0, _styled(text)).otherwise(around(links)))


def _block(line: Column) -> Column:
    """(kind, level, text) of a line; blank lines are a kind of their own."""
    return X.bound(F.regexp_replace(line, r"(?U)^\s+", ""), lambda left: _told(line, left))


def _told(line: Column, left: Column) -> Column:
    kind = (
        F.when(left == "", "blank").when(line.rlike(HEADING), "heading").when(line.rlike(RULE), "rule")
        .when(left.startswith("> "), "quote").when(left.rlike(r"^[-*] "), "bullet").otherwise("paragraph")
    )
    level = F.when(kind == "heading", F.length(F.regexp_extract(line, "^(#{1,6})", 1))).otherwise(0)
    text = F.when(kind == "heading", X.ustrip(F.regexp_replace(line, HEADING, ""))).when(kind.isin("rule", "blank"), "").when(kind.isin("quote", "bullet"), X.ustrip(F.substring(left, 3, F.length(left)))).otherwise(X.ustrip(line))
    return F.struct(kind.alias("kind"), level.alias("level"), text.alias("text"))


def markdown_blocks(documents: DataFrame, md: str = "md") -> DataFrame:
    """(item_id, line_no, kind, level, text, run): one row per non-blank line; run numbers the bullet runs, which blank lines end."""
    rows = documents.select("item_id", F.posexplode(F.transform(F.split(md, LINE_ENDS), _block)).alias("line_no", "b")).select("item_id", "line_no", "b.*")
    w = Window.partitionBy("item_id").orderBy("line_no")
    opens = (F.col("kind") == "bullet") & ~F.coalesce(F.lag("kind").over(w) == "bullet", F.lit(False))
    rows = rows.withColumn("_run", F.sum(opens.cast("int")).over(w))
    return rows.where("kind <> 'blank'").select("item_id", "line_no", "kind", "level", "text", F.when(F.col("kind") == "bullet", F.col("_run")).alias("run"))


def _html(block: Column, before: Column, after: Column) -> Column:
    """A block's element; the first bullet of a run opens the list and the last one closes it."""
    return X.bound(inline_html(block["text"]), lambda inner: _element(block, before, after, inner))


def _element(block: Column, before: Column, after: Column, inner: Column) -> Column:
    wrap = lambda tag: F.concat(F.lit(f"<{tag}>"), inner, F.lit(f"</{tag}>"))
    level, kind = block["level"].cast("string"), block["kind"]
    other = lambda x: F.coalesce(x["kind"] != "bullet", F.lit(True))
    item = F.concat(F.when(other(before), "<ul>\n").otherwise(""), wrap("li"), F.when(other(after), "\n</ul>").otherwise(""))
    html = F.when(kind == "heading", F.concat(F.lit("<h"), level, F.lit(">"), inner, F.lit("</h"), level, F.lit(">"))).when(kind == "rule", "<hr/>")
    return html.when(kind == "quote", wrap("blockquote")).when(kind == "bullet", item).when(kind == "paragraph", wrap("p"))


def render_xhtml(documents: DataFrame, md: str = "md", language: str = "zh-CN") -> DataFrame:
    """The documents with ``xhtml``: blocks in order, bullet runs as lists, in a document envelope; null where the text is null.

    All lines of a document are worked on in its row; nothing is shuffled.
    """
    style = "".join(f"    {x}\n" for x in STYLES.strip().split("\n"))
    head = f"{PROLOGUE}<html xmlns='http://www.w3.org/1999/xhtml' xml:lang='{language}' lang='{language}'>\n<head>\n  <meta charset='utf-8'/>\n  <title>Content</title>\n  <style>\n{style}  </style>\n</head>\n<body>\n"
    rows = documents.withColumn("_blocks", F.transform(F.split(md, LINE_ENDS), _block))
    at = lambda i: F.get("_blocks", i)
    html = F.transform("_blocks", lambda b, i: _html(b, at(i - 1), at(i + 1)))
    body = F.array_join(html, "\n")  # blank lines have no element and are left out
    return rows.withColumn("xhtml", F.concat(F.lit(head), body, F.lit("\n</body>\n</html>\n"))).drop("_blocks")


def book_table(state: DataFrame, documents: DataFrame, force_all: bool = False) -> DataFrame:
    """(item_id, title, pub_time, path, xhtml, outcome) of publishable items.

    state: item_id, status, pubdate, transcript_md, summary_md; documents: path, md.  A missing file is an error outcome.
    """
    from talkweave.operators import rules

    rows = rules.with_transcripts(state) if force_all else state.where(F.col("status").isin(S.PUBLISHABLE))
    rows = rules.publish_source(rows).join(documents.withColumnRenamed("path", "source_path"), "source_path", "left")
    title = X.extract_title(F.coalesce("md", F.lit("")), F.col("item_id"))
    rows = rows.withColumns({"title": title, "pub_time": X.format_pub_time(F.col("pubdate"))})
    rows = rows.withColumn("md", F.when(F.col("pub_time") != "", X.inject_pub_line(F.col("md"), F.col("title"), F.col("pub_time"))).otherwise(F.col("md")))
    rows = render_xhtml(rows).withColumn("path", F.concat(X.safe_filename(F.col("title")), F.lit(".epub"))).withColumn("outcome", F.when(F.col("md").isNull(), "error").otherwise("converted"))
    return rows.select("item_id", "title", "pub_time", "path", "outcome", "xhtml")


def path_conflicts(books: DataFrame, order: str = "pos") -> DataFrame:
    """Books with the number of items of the same path, and whether this one is the last writer."""
    w = Window.partitionBy("path")
    return books.withColumns({"n_items": F.count("*").over(w), "wins": F.row_number().over(w.orderBy(F.desc(order))) == 1})


def stale_paths(books: DataFrame) -> DataFrame:
    """(item_id, epub_path): former outputs named by id that the new path replaces."""
    name = F.element_at(F.split("epub_path", "/"), -1)
    return books.where((name == F.concat("item_id", F.lit(".epub"))) & (F.col("epub_path") != F.col("path"))).select("item_id", "epub_path")
