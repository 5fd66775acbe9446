import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from talkweave.functions import lookup
from talkweave.functions import text as X

x = None


@pytest.fixture(autouse=True)
def _column(spark):
    global x  # columns need a session
    x = F.col("x")


def test_detect_language(column):
    cases = ["This is clearly english text without any CJK.", "这是明显的中文文本。", "これは日本語のテキストです。", "", "  　", "の" + "a" * 4, "中" * 3 + "a" * 7]
    assert column(X.detect_language(x), cases) == ["en", "zh", "ja", "zh", "zh", "en", "en"]


def test_strip_think_and_hallucinations(column):
    assert column(X.strip_think(x), ["<think>a\nb</think> ok <think>open\nx", " plain "]) == ["ok", "plain"]
    assert column(X.strip_hallucinations(x), ["a谢谢收看  b", "a\n \n \nb", "请不吝点赞 订阅 转发 打赏支持明镜与点点栏目"]) == ["a b", "a\n\nb", ""]


def test_safe_filename(column):
    assert column(X.safe_filename(x), ['a<b>:"c/d\\e|f?g*', "...", "", " 中 文 ", "x. y._"]) == ["a_b___c_d_e_f_g", "untitled", "untitled", "中_文", "x._y"]
    assert column(X.safe_filename(x, 50), ["A" * 200]) == ["A" * 50]


def test_title_and_body(column):
    assert column(X.extract_title(x, F.lit("id")), ["a\n# T \nb", "\n first \n", "# \nnext", "", " \n"]) == ["T", "first", "#", "id", "id"]
    assert column(X.extract_body(x), ["# t\n---\n\n body \n", "no rule ", " --- tail", "a\n---"]) == ["body", "no rule ", "--- tail", "a\n---"]


def test_pub_line(column):
    f = X.inject_pub_line(x, F.lit("T$1"), F.lit("2024"))
    line = "**发布时间**: 2024"
    assert column(f, ["# T$1\nUP主：a\nb", "x\n# T$1 more\nb", "**UP主**: a"]) == [f"# T$1\nUP主：a\n\n{line}\nb", f"x\n# T$1 more\n\n{line}\nb", f"{line}\n\n**UP主**: a"]
    assert column(X.format_pub_time(F.col("x")), [0, None, 1_700_000_000], "x long") == ["", "", "2023-11-14 22:13"]


def test_timestamps(column):
    assert column(X.format_timestamp(x), [0.9, 61.0, 3600.0, 36061.5], "x double") == ["00:00", "01:01", "01:00:00", "10:01:01"]


def test_labels(column):
    assert column(X.id_label(x), ["SPEAKER_00", "SPEAKER_26", "Bob"]) == ["[说话人 A]", "[说话人 27]", "[Bob]"]
    assert column(X.rank_label(F.col("x")), [0, 25, 26], "x int") == ["[说话人 A]", "[说话人 Z]", "[说话人 27]"]


def test_speaker_map_and_tags(column):
    maps = column(X.normalise_speaker_map(x, F.lit("Ann")), ['x {"[说话人 A]": " Ann ", "B": "NULL", "C": "", "D": null} y', "none", "{bad"])
    assert maps == [{"说话人A": "主持人"}, {}, {}]
    names = F.create_map(F.lit("说话人A"), F.lit("$1\\x"), F.lit("SPEAKER_01"), F.lit("Bo"))
    assert column(X.replace_speaker_tags(x, names), ["**[说话人 A]**: hi **SPEAKER_01** ho"]) == ["**[$1\\x]** hi **[Bo]** ho"]
    assert column(X.replace_speaker_tags(x, names), ["**[SPEAKER_01]** a", "**说话人 A** b", "**[说话人\u3000A]**：c", "**[说话人_A]**d"]) == ["**[Bo]** a", "**[$1\\x]** b", "**[$1\\x]** c", "**[$1\\x]** d"]
    assert column(X.to_simplified(x, {"發": "发", "頭": "头"}, {"頭髮": "头发", "發": "X", "發現": "发现"}), ["頭髮發現發頭", ""]) == ["头发发现X头", ""]
    assert column(X.collapse_repeated_tags(x), ["**[a]**: **[a]**: b"]) == ["**[a]**: b"]
    assert column(X.speaker_info_text(F.create_map(F.lit("A"), x)), ["b"]) == ["A 是 b"]


def test_prompts_expand_in_order(column):
    assert column(X.build_prompt(F.lit("{text}-{title}-{author}"), text=x, title=F.lit("T"), author=F.lit("")), ["see {title}"]) == ["see T-T-未知UP主"]


def test_requests_and_answers(column):
    assert column(X.request_json("chunk", F.lit("p"), x), ["abc"]) == ['{"model":"model","prompt":"p","stream":false,"options":{"temperature":0.1,"num_predict":1006}}']
    assert column(X.response_text(x), ['{"response": " <think>a</think>b "}']) == ["b"]
    assert column(X.accept_chunk(F.lit("0123456789"), x), ["abc", "ab", None]) == ["abc", "0123456789", "0123456789"]
    assert column(X.accept_paragraph(F.lit("a" * 20), x), ["b" * 10, "b" * 9, "b" * 40, "b" * 41]) == ["b" * 10, "a" * 20, "b" * 40, "a" * 20]
    failed = X.accept_summary(F.lit("abc"), F.lit(None), x)
    assert column(failed["summary"], ["read Timeout", "boom"]) == ["总结失败：API 超时。原始内容长度: 3", "总结失败：boom"]


def test_bilingual(column):
    assert column(X.needs_bilingual(x, True), ["zh", "EN", None]) == [False, True, True]
    assert column(X.needs_bilingual(x, False), [None]) == [False]


def test_patterns():
    assert X.valid_patterns(["(?i)a", "[bad", " "]) == ["a"]


def test_deny_table_of_100000_entries(spark):
    """Equal to SQL contains; blank and null entries deny nothing, and the first entry by pos wins."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdEFé ") for _ in range(n))
    entries = [(word(rng.randint(4, 9)), k) for k in range(100_000)] + [("", -1), (None, -2), (" \u3000", -3)]
    titles = [(k, word(rng.randint(0, 60))) for k in range(300)] + [(900, None), (901, "")]
    known = spark.createDataFrame(entries, "entry string, pos long").repartition(4)
    got = lookup.denied_by(spark.createDataFrame(titles, "id int, title string"), "title", known)
    deny = pd.DataFrame([(e.lower(), e, p) for e, p in entries if e and e.strip()], columns=["low", "entry", "pos"])  # noqa: F841
    asked = pd.DataFrame(titles, columns=["id", "title"])  # noqa: F841
    want = duckdb.sql("SELECT id, (SELECT arg_min(entry, pos) FROM deny WHERE contains(lower(title), low)) FROM asked").fetchall()
    assert sorted((r.id, r.denied_by) for r in got.collect()) == sorted(want)
    assert lookup.denied_by(got.drop("denied_by"), "title", known.where("false")).where("denied_by IS NOT NULL").count() == 0


def test_deny_table_in_parts(spark, monkeypatch):
    monkeypatch.setattr(lookup, "CHARACTERS", 10)
    entries = spark.createDataFrame([("abc", 3), ("bcd", 1), ("CDE", 2), ("xyz", 0), ("", 9)], "entry string, pos long")
    rows = spark.createDataFrame([("zabcdez",), ("cde",), ("none",), (None,)], "t string")
    assert sorted(map(str, (r.denied_by for r in lookup.denied_by(rows, "t", entries).collect()))) == sorted(["bcd", "CDE", "None", "None"])


def longest_first(text, table, single):
    out, at = [], 0
    while at < len(text):
        size = next((n for n in range(max(map(len, table)), 0, -1) if text[at : at + n] in table and at + n <= len(text)), 0)
        out.append(table[text[at : at + size]] if size else single.get(text[at], text[at]))
        at += size or 1
    return "".join(out)


def test_phrases_of_a_large_table(spark, monkeypatch):
    """50,000 phrases, equal to a plain loop; texts are cut into pieces, and end and begin in the middle of phrases."""
    monkeypatch.setattr(lookup, "PIECE", 64)
    rng = random.Random(6)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    table = {word(rng.randint(1, 7), "abcd𠀀發現"): word(rng.randint(0, 4), "xy\\$") for _ in range(50_000)}
    table.pop("a", None)
    single = {"a": "A", "é": "e"}
    texts = [word(rng.randint(0, 300), "abcd𠀀發現é \n\0") for _ in range(60)] + ["", None, "é" * 5000, "abc" * 4000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.v for r in rows.select("id", lookup.replace_phrases(F.col("t"), table, single).alias("v")).collect()}
    assert got == {i: None if t is None else longest_first(t, table, single) for i, t in enumerate(texts)}
    few = {"ab": "1", "abc": "2", "": "never", "c\0": "never"}
    frame = spark.createDataFrame([("abcab c\0ab",)], "t string").select(lookup.replace_phrases(F.col("t"), few).alias("v"), X.to_simplified(F.col("t"), {}, {"ab": "1", "abc": "2"}).alias("same"))
    assert tuple(frame.first()) == ("21 c\0" + "1", "21 c\0" + "1")
    assert rows.select(lookup.replace_phrases(F.col("t"), {}).alias("v")).where("v IS NOT DISTINCT FROM ''").count() == 1
