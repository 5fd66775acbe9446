"""Column functions over titles, transcripts and model responses.

All are native expressions.  "White space" is Unicode white space, as (?U)\\s.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that speech models invent over silence, in the order of their removal.
HALLUCINATIONS = [
    r"请不吝点赞\s*订阅\s*转发\s*打赏支持明镜与点点栏目",
    "请不吝点赞、订阅、转发、打赏支持明镜与点点栏目",
    "谢谢收看",
    "感谢收看",
    "请注意使用逗号、句号和感叹号。这是一段视频的语音转录，",
    "这是一段视频的语音转录，请注意使用逗号、句号和感叹号。",
]
# Labels in rendered documents.
AUTHOR_LABEL, TIME_LABEL, FULL_TEXT_HEADING = "UP主", "发布时间", "完整文本"
SPEAKER_WORD, HOST_NAME, UNKNOWN_TITLE, UNKNOWN_AUTHOR, NO_SPEAKERS = "说话人", "主持人", "未知标题", "未知UP主", "无"
SUMMARY_TIMEOUT, SUMMARY_FAILED = "总结失败：API 超时。原始内容长度: ", "总结失败："
NO_TRANSCRIPT = "(转录失败或无文字内容)"


def ustrip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of the value, which is worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def filled(text: Column) -> Column:
    """Null where the text is empty."""
    return F.nullif(text, F.lit(""))


def quoted(text: Column) -> Column:
    """A pattern that matches the text itself."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def literal_replacement(text: Column) -> Column:
    """A regexp_replace replacement that stands for the text itself."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def detect_language(text: Column) -> Column:
    """ja if over 0.2 of the visible characters are kana, else zh if over 0.3 are Han, else en; nothing visible: zh."""
    visible = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    share = lambda chars: F.regexp_count(text, F.lit(f"[{chars}]")) / visible
    return (
        F.when(F.coalesce(visible, F.lit(0)) == 0, "zh")
        .when(share("぀-ゟ゠-ヿ") > 0.2, "ja")
        .when(share("一-鿿") > 0.3, "zh")
        .otherwise("en")
    )


def language_of_item(configured: str | None, text: Column, reported: Column | None = None, fallback: str | None = None) -> Column:
    """The configured language, or else that of the text; engines that report one: reported, configured, fallback."""
    if reported is not None:
        return F.coalesce(filled(reported), F.lit(configured), F.lit(fallback))
    return F.lit(configured) if configured else detect_language(text)


def strip_think(text: Column) -> Column:
    """Without <think> sections, of which the last may be unclosed."""
    return ustrip(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""))


def strip_hallucinations(text: Column, patterns: list[str] | None = None) -> Column:
    """Without invented phrases; the gaps they leave are closed."""
    clean = reduce(lambda t, p: F.regexp_replace(t, p, ""), HALLUCINATIONS if patterns is None else patterns, text)
    return ustrip(F.regexp_replace(F.regexp_replace(clean, " {2,}", " "), r"(?U)\n\s*\n\s*\n", "\n\n"))


def to_simplified(text: Column, table: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> Column:
    """Phrases (the longest that fits first), then single characters replaced by tables; without tables, unchanged."""
    one = (lambda t: F.translate(t, "".join(table), "".join(table.values()))) if table else (lambda t: t)
    if not phrases:
        return one(text)
    pattern = "|".join(r"\Q" + p + r"\E" for p in sorted(phrases, key=len, reverse=True))
    known = F.create_map(*[F.lit(x) for kv in phrases.items() for x in kv])
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    parts = F.zip_with(F.split(text, pattern, -1), found, lambda t, p: F.concat(one(t), F.coalesce(known[p], F.lit(""))))
    return F.array_join(parts, "")


def format_timestamp(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from one hour on; fractions are cut off."""
    whole = F.floor(seconds).cast("long")
    h, m, s = F.floor(whole / 3600).cast("int"), F.pmod(F.floor(whole / 60), F.lit(60)).cast("int"), F.pmod(whole, F.lit(60)).cast("int")
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def timestamped_line(start: Column, end: Column, text: Column, decimal: bool = False) -> Column:
    """[start --> end] text, or [s.s-e.e] text."""
    if decimal:
        return F.format_string("[%.1f-%.1f] %s", start.cast("double"), end.cast("double"), text)
    return F.concat(F.lit("["), format_timestamp(start), F.lit(" --> "), format_timestamp(end), F.lit("] "), text)


def _tag(index: Column) -> Column:
    """A-Z for 0-25, then the number plus one."""
    return F.when(index < 26, F.char(index + 65)).otherwise((index + 1).cast("string"))


def rank_label(rank: Column) -> Column:
    """Label of the speaker with this 0-based rank among the item's sorted speakers."""
    return F.concat(F.lit(f"[{SPEAKER_WORD} "), _tag(rank.cast("int")), F.lit("]"))


def id_label(speaker: Column) -> Column:
    """Label of SPEAKER_n by n; anything else in brackets."""
    index = F.regexp_extract(speaker, "^SPEAKER_([0-9]+)$", 1).try_cast("int")
    return F.when(index.isNotNull(), rank_label(index)).otherwise(F.concat(F.lit("["), speaker, F.lit("]")))


def extract_body(md: Column) -> Column:
    """What follows the line of the first ---, stripped; without --- the whole text as it is."""
    rule = F.instr(md, "---")
    feed = F.locate("\n", F.substring(md, rule, F.length(md)))
    return F.when(rule == 0, md).when(feed == 0, ustrip(md)).otherwise(ustrip(F.substring(md, rule + feed, F.length(md))))


def safe_filename(title: Column, most: int = 100) -> Column:
    """A title as a file name: reserved characters and white space become _, outer . and _ go, cut to ``most``."""
    name = F.regexp_replace(F.regexp_replace(title, r'[<>:"/\\|?*]', "_"), r"(?U)\s+", "_")
    name = F.regexp_replace(name, r"^[._]+|[._]+$", "")
    name = F.when(F.length(name) > most, F.regexp_replace(F.substring(name, 1, most), "_+$", "")).otherwise(name)
    return F.coalesce(filled(name), F.lit("untitled"))


def extract_title(md: Column, item_id: Column) -> Column:
    """The first "# " heading; without one (or if it is empty) the first non-blank line; else the id."""
    heading = F.regexp_extract(md, r"(?m)^# ([^\n]*)$", 1)
    first = F.regexp_extract(md, r"(?U)^\s*(\S[^\n]*)", 1)
    return F.coalesce(filled(ustrip(heading)), filled(ustrip(first)), item_id)


def format_pub_time(epoch: Column) -> Column:
    """yyyy-MM-dd HH:mm in the session zone; null or 0 gives the empty text."""
    return F.when(F.coalesce(epoch, F.lit(0)) == 0, "").otherwise(F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm"))


def inject_pub_line(md: Column, title: Column, time: Column, ascii_colon: bool = False) -> Column:
    """The publishing time after the first author line (full-width colon), else after the title line, else in front."""
    line = F.concat(F.lit(f"**{TIME_LABEL}**: "), time)
    after = literal_replacement(F.concat(F.lit("\n\n"), line))
    colon = "[：:]" if ascii_colon else "："
    author = rf"(?m)^(?:\*\*{AUTHOR_LABEL}\*\*|{AUTHOR_LABEL}){colon}[^\n]*$"
    heading = F.concat(F.lit("(?m)^# "), quoted(title), F.lit(r"[^\n]*$"))
    first = lambda pattern: F.regexp_replace(md, F.concat(F.lit(r"(?s)\A(.*?)("), pattern, F.lit(")")), F.concat(F.lit("$1$2"), after))
    return F.when(F.regexp_like(md, F.lit(author)), first(F.lit(author))).when(F.regexp_like(md, heading), first(heading)).otherwise(F.concat(line, F.lit("\n\n"), md))


def normalise_speaker_map(response: Column, author: Column) -> Column:
    """The JSON object in a response as a map: null-like values dropped, brackets and white space cut from keys, the author renamed."""
    entries = F.from_json(F.regexp_extract(response, r"(?s)\{.*\}", 0), "map<string,string>")
    entries = F.map_filter(entries, lambda _, v: v.isNotNull() & (ustrip(v) != "") & (F.lower(ustrip(v)) != "null"))
    named = F.transform_values(entries, lambda _, v: F.when((F.coalesce(author, F.lit("")) != "") & (ustrip(v) == author), HOST_NAME).otherwise(ustrip(v)))
    pairs = F.transform(F.map_entries(named), lambda e: F.struct(F.regexp_replace(e["key"], r"(?U)[\[\]\s]", "").alias("key"), e["value"].alias("value")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def replace_speaker_tags(text: Column, names: Column, keep_punctuation: bool = False) -> Column:
    """Bold speaker tags, in brackets or not, replaced by names, entry by entry; keep_punctuation also skips keys without a speaker id."""
    gap = r"(?U:[\s_]*)"
    pattern = rf"(?i)(?:{SPEAKER_WORD}|SPEAKER){gap}([A-Z0-9]+)"

    def one(text: Column, entry: Column) -> Column:
        found = filled(F.regexp_extract(entry["key"], pattern, 1))
        name = quoted(found if keep_punctuation else F.coalesce(found, entry["key"]))
        tail = "" if keep_punctuation else r"(?U:[:：\s]*)"
        tag = F.concat(F.lit(rf"\*\*\[?(?:{SPEAKER_WORD}|SPEAKER){gap}"), name, F.lit(r"\]?\*\*" + tail))
        new = F.concat(F.lit("**["), literal_replacement(entry["value"]), F.lit("]**" if keep_punctuation else "]** "))
        return F.coalesce(F.regexp_replace(text, tag, new), text)

    return F.aggregate(F.map_entries(names), text, one)


def collapse_repeated_tags(text: Column, before_names: bool = True) -> Column:
    """Runs of one bold tag reduced to the first."""
    return F.regexp_replace(text, r"(?U)(\*\*\[[^\]]+\]\*\*" + (r"[：:\s]*" if before_names else r"\s*") + r")\1+", "$1")


def speaker_info_text(names: Column) -> Column:
    """Who is who, in one line."""
    parts = F.transform(F.map_entries(names), lambda e: F.concat(e["key"], F.lit(" 是 "), e["value"]))
    return F.coalesce(filled(F.array_join(parts, ", ")), F.lit(NO_SPEAKERS))


def is_chinese(language: Column) -> Column:
    return F.lower(language).isin("zh", "chinese", "cmn")


def needs_bilingual(language: Column, when_null: bool) -> Column:
    """Is a bilingual instruction needed?  Batches assume so for an unknown language, single paragraphs don't."""
    return F.coalesce(~is_chinese(language), F.lit(when_null))


def build_prompt(template: Column, **values: Column) -> Column:
    """Placeholders replaced one after the other in the order given, so text that holds placeholders is expanded by later ones."""
    defaults = {"title": UNKNOWN_TITLE, "author": UNKNOWN_AUTHOR}
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), F.coalesce(filled(kv[1]), F.lit(defaults[kv[0]])) if kv[0] in defaults else F.coalesce(kv[1], F.lit(""))), values.items(), template)


# Per kind of request, temperature, tokens per character and tokens besides.
REQUESTS = {"filter": (0.0, 0, 512), "speakers": (0.0, 0, 512), "paragraph": (0.1, 2, 500), "chunk": (0.1, 2, 1000), "summary": (0.3, 0, 4096)}


def request_json(kind: str, prompt: Column, text: Column, model: str = "model") -> Column:
    """The request body of a generation call."""
    temperature, per, plus = REQUESTS[kind]
    options = F.struct(F.lit(temperature).alias("temperature"), (F.length(text) * per + plus).alias("num_predict"))
    return F.to_json(F.struct(F.lit(model).alias("model"), prompt.alias("prompt"), F.lit(False).alias("stream"), options.alias("options")))


def response_text(body: Column) -> Column:
    """The answer in a response body, without thinking."""
    return strip_think(ustrip(F.from_json(body, "response string")["response"]))


def accept_chunk(chunk: Column, response: Column) -> Column:
    """The response, unless it is missing or shorter than 0.3 of the chunk."""
    return F.when(response.isNull() | (F.length(response) < 0.3 * F.length(chunk)), chunk).otherwise(response)


def accept_paragraph(paragraph: Column, response: Column) -> Column:
    """The response if its length is 0.5 to 2 times the paragraph's; paragraphs under 20 characters stay."""
    n, r = F.length(paragraph), F.length(response)
    fits = (F.length(ustrip(paragraph)) >= 20) & (r >= 0.5 * n) & (r <= 2 * n)
    return F.when(F.coalesce(fits, F.lit(False)), response).otherwise(paragraph)


def accept_summary(text: Column, response: Column, error: Column) -> Column:
    """(summary, is_short, is_error): failures become a text that says so."""
    failed = F.when(F.lower(error).contains("timeout"), F.concat(F.lit(SUMMARY_TIMEOUT), F.length(text).cast("string"))).otherwise(F.concat(F.lit(SUMMARY_FAILED), error))
    summary = F.when(error.isNotNull(), failed).otherwise(response)
    return F.struct(summary.alias("summary"), F.coalesce(error.isNull() & (F.length(response) < 100), F.lit(False)).alias("is_short"), error.isNotNull().alias("is_error"))


def truncate_sample(text: Column, most: int = 5000) -> Column:
    return F.substring(text, 1, most)


def parse_iso(text: Column) -> Column:
    """A timestamp from ISO text, zone or Z accepted; null if it is none."""
    return F.try_to_timestamp(text)


def valid_patterns(patterns: list[str]) -> list[str]:
    """Non-blank patterns that compile where they are matched, in the JVM; a leading (?i) is dropped, as matching ignores case anyway."""
    java = SparkContext._active_spark_context._jvm.java.util.regex

    def compiles(pattern: str) -> bool:
        try:
            java.Pattern.compile(pattern)
        except (IllegalArgumentException, Py4JJavaError):
            return False
        return True

    return [p.removeprefix("(?i)") for p in patterns if p.strip() and compiles("(?iu)" + p.removeprefix("(?i)"))]
