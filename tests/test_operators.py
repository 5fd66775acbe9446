import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkweave.operators import infer, publish, reports, rules, state, turns
from talkweave.sources import files


def rows(frame, *order):
    return [tuple(r) for r in (frame.orderBy(*order) if order else frame).collect()]


def test_rules(spark):
    schema = "pos int, item_id string, title string, url string, duration_s int, author string"
    catalog = spark.createDataFrame([(0, "a", "fine", "u", 60, "x"), (1, "b", "fine", "u", 59, "x"), (2, "c", "fine", "u", 99, "My SPAM tv"), (3, "d", "Big 抽奖", "u", 99, None), (4, "", "t", "u", 99, "x")], schema)
    r = rules.Rules(60, ["spam", ""], ["(?i)抽奖", "[bad"], False)
    assert [x["drop_reason"] for x in rules.drop_reason(catalog, r).orderBy("pos").collect()] == [None, "too_short", "author", "title", "missing_fields"]
    assert rules.rule_filter(catalog, rules.Rules()).count() == 5


def test_upsert_null_overwrites(spark):
    before = spark.createDataFrame([("a", "new", "e"), ("b", "new", "e")], "item_id string, status string, error string")
    updates = spark.createDataFrame([("a", 2, {"error": None}), ("a", 1, {"error": "x", "status": "s"}), ("c", 1, {"status": "n"}), ("d", 1, {})], "item_id string, seq int, fields map<string,string>")
    assert rows(state.upsert_state(before, updates, ["status", "error"]), "item_id") == [("a", "s", None), ("b", "new", "e"), ("c", "n", None), ("d", None, None)]


def test_queue_cap(spark):
    catalog = spark.createDataFrame([(i, k) for i, k in enumerate(["", "a", "b", "c", "a"])], "pos int, item_id string")
    states = spark.createDataFrame([("a", "uploaded"), ("b", "error")], "item_id string, status string")
    queue, seen = state.build_queue(catalog, states, 1)
    assert [r["item_id"] for r in queue.collect()] == ["b"] and sorted(r["item_id"] for r in seen.collect()) == ["a", "b"]
    queue, seen = state.build_queue(catalog, states, 0)
    assert queue.count() == 1
    assert state.build_queue(catalog, states, 9)[1].count() == 4


def test_capped_scan_passes_uncounted_rows_across_ranges(spark):
    frame = spark.createDataFrame([(i, i % 3 == 0) for i in range(30)], "pos int, c boolean")
    for span in (1, 7, 100):
        got = state.counted_before(frame, F.col("c"), span=span).orderBy("pos").collect()
        assert [r["before"] for r in got] == [len(range(0, i, 3)) for i in range(30)]


def test_recovery_and_reset(spark):
    states = spark.createDataFrame([("a", "error", "p", "e"), ("b", "error", "q", "e"), ("c", "transcribing", "p", None), ("d", "downloading", "p", None)], "item_id string, status string, audio_path string, error string")
    got = rows(state.recover_state(states, spark.createDataFrame([("p",)], "path string")), "item_id")
    assert [(r[0], r[1], r[3], r[4]) for r in got] == [("a", "downloaded", None, True), ("b", "new", None, True), ("c", "downloaded", None, True), ("d", "downloading", None, False)]
    given = spark.createDataFrame([("a", "new", None, True), ("b", "new", None, False), ("c", "success", "e", True)], "item_id string, status string, error string, has_error boolean")
    assert [r["changed"] for r in state.reset_unfinished(given).orderBy("item_id").collect()] == [True, False, False]


def test_outcome_updates(spark):
    given = spark.createDataFrame([("a", 1, "transcribe", "error", "boom", None, "x"), ("b", 1, "upload", "error", None, None, "x"), ("c", 1, "publish", "converted", None, {"title": "t"}, "summarized"), ("d", 1, "publish", "converted", None, None, "uploaded")], "item_id string, seq int, stage string, outcome string, detail string, extra map<string,string>, status string")
    got = {r["item_id"]: r["fields"] for r in state.outcome_updates(given).collect()}
    assert got == {"a": {"status": "error", "error": "Transcription failed: boom"}, "b": {}, "c": {"title": "t", "status": "success"}, "d": {}}


def fold_merge(items, gap, span):
    out = []
    for speaker, start, end, text in items:
        if out and out[-1][0] == speaker and start - out[-1][2] <= gap and end - out[-1][1] <= span:
            out[-1] = (speaker, out[-1][1], end, out[-1][3] + " " + text)
        else:
            out.append((speaker, start, end, text))
    return out


def test_merge_and_batch_turns(spark):
    import random

    rng = random.Random(3)
    items, t = [], 0.0
    for i in range(300):
        d = rng.choice([1.0, 5.0, 60.0, 119.0, 250.0])
        items.append((rng.choice("AB"), t, t + d, f"w{i}"))
        t += d + rng.choice([-2.0, 0.0, 3.0, 3.5])
    frame = spark.createDataFrame([("x", i, *r) for i, r in enumerate(items)], "item_id string, seq int, speaker string, start_s double, end_s double, text string")
    got = [(r.speaker, r.start_s, r.end_s, r.text) for r in turns.merge_turns(frame).orderBy("seq").collect()]
    assert got == fold_merge(items, 3.0, 120.0)
    expected, b, n, s = [], 0, 0, 0.0
    for _, start, end, _ in items:
        d = end - start
        if n and (n >= 8 or s + d > 240):
            b, n, s = b + 1, 0, 0.0
        n, s = n + 1, s + d
        expected.append(b)
    assert [r.batch_no for r in turns.batch_turns(frame).orderBy("seq").collect()] == expected


def test_packing_edges(column):
    pack = turns.pack_paragraphs
    assert column(pack(F.col("x"), 5), ["", "abc", "ab。cd。ef", "abcdefgh。i。", "  "]) == [[], ["abc"], ["ab。", "cd。ef"], ["abcdefgh。", "i。"], ["  "]]
    assert column(pack(F.col("x"), 5, False), ["ab。cd。efgh", "ab"]) == [["ab。", "cd。efgh"], ["ab"]]
    line = "a" * 4
    assert column(turns.pack_chunks(F.col("x"), 10), [f"{line}\n\n{line}\n{line}", " "]) == [[f"{line}\n\n{line}", line], [" "]]


def test_plan_chunks(spark):
    items = spark.createDataFrame([("a", 210), ("b", 211), ("c", 360)], "item_id string, duration_s int")
    assert rows(turns.plan_chunks(items), "item_id", "chunk_no") == [("a", 0, 0, 210), ("b", 0, 0, 180), ("b", 1, 180, 211), ("c", 0, 0, 180), ("c", 1, 180, 360)]


def test_significance_edges(spark):
    t = spark.createDataFrame([("a", 0, "X", "x" * 100), ("a", 1, "Y", "y" * 1900), ("b", 0, "P", "p"), ("b", 1, "Q", "q")], "item_id string, seq int, speaker string, text string")
    got = {(r.item_id, r.speaker): (r.prominent, r.significant) for r in turns.significant_speakers(turns.speaker_stats(t)).collect()}
    assert got == {("a", "X"): (False, False), ("a", "Y"): (True, True), ("b", "P"): (True, True), ("b", "Q"): (False, True)}


def test_assign_speakers(spark):
    segments = spark.createDataFrame([("a", 0, 0.0, 130.0), ("a", 1, 200.0, 201.0)], "item_id string, seq int, start_s double, end_s double")
    voices = spark.createDataFrame([("a", "B", 0.0, 60.0), ("a", "A", 60.0, 120.0), ("a", "B", 120.0, 121.0)], "item_id string, speaker string, start_s double, end_s double")
    assert [r.speaker for r in turns.assign_speakers(segments, voices).orderBy("seq").collect()] == ["B", None]


def test_render_transcript(spark):
    items = spark.createDataFrame([("a", "T", "U"), ("b", "S", "")], "item_id string, title string, author string")
    t = spark.createDataFrame([("a", 0, "X", "Hello there."), ("a", 1, "Y", "Yes.")], "item_id string, seq int, speaker string, text string")
    got = dict(rows(turns.render_transcript(items, t)))
    assert got == {"a": "# T\n\n**UP主**: U\n\n---\n\n**[说话人 A]** Hello there.\n\n**[说话人 B]** Yes.\n", "b": "# S\n\n---\n\n(转录失败或无文字内容)\n"}


def test_markdown(spark):
    md = "# T\n\n- a\n- b\n\n- **c** [l](u_v_w)\n> q\n---\n`x` <y>\nplain"
    blocks = publish.markdown_blocks(spark.createDataFrame([("i", md)], "item_id string, md string"))
    assert [(r.kind, r.level, r.text, r.run) for r in blocks.orderBy("line_no").collect()] == [("heading", 1, "T", None), ("bullet", 0, "a", 1), ("bullet", 0, "b", 1), ("bullet", 0, "**c** [l](u_v_w)", 2), ("quote", 0, "q", None), ("rule", 0, "", None), ("paragraph", 0, "`x` <y>", None), ("paragraph", 0, "plain", None)]
    html = publish.render_xhtml(spark.createDataFrame([("i", md)], "item_id string, md string")).first()["xhtml"]
    body = html.split("<body>\n")[1].split("\n</body>")[0]
    assert body == '<h1>T</h1>\n<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n<ul>\n<li><b>c</b> <a href="u_v_w">l</a></li>\n</ul>\n<blockquote>q</blockquote>\n<hr/>\n<p><code style="background:#f4f4f4;padding:0 2px"> x </code> &lt;y&gt;</p>\n<p>plain</p>'


def test_markdown_white_space_and_line_ends(spark):
    md = "  - x\n\t> q\u2028* y\u001cz\r\n  ***  "
    frame = spark.createDataFrame([("i", md), ("n", None)], "item_id string, md string")
    assert [(r.kind, r.text) for r in publish.markdown_blocks(frame).orderBy("line_no").collect()] == [("bullet", "x"), ("quote", "q"), ("bullet", "y"), ("paragraph", "z"), ("rule", "")]
    html = {r.item_id: r.xhtml for r in publish.render_xhtml(frame).collect()}
    assert html["n"] is None and html["i"].startswith("<?xml") and " lang='zh-CN'>" in html["i"] and "<style>" in html["i"]
    assert html["i"].split("<body>\n")[1] == "<ul>\n<li>x</li>\n</ul>\n<blockquote>q</blockquote>\n<ul>\n<li>y</li>\n</ul>\n<p>z</p>\n<hr/>\n</body>\n</html>\n"


def test_pack_segments_and_long_texts(spark):
    rows_ = spark.createDataFrame([("a", i, t) for i, t in enumerate(["x" * 300, " ", "y" * 200, "z", None])] + [("b", 0, "q")], "item_id string, seq int, text string")
    got = rows(turns.pack_segments(rows_, ["item_id"]), "item_id", "paragraph_no")
    assert got == [("a", 0, "x" * 300 + "y" * 200), ("a", 1, "z"), ("b", 0, "q")]
    long = spark.range(1).select(F.repeat(F.lit("Twelve chars."), 64_000).alias("t")).select(turns.pack_paragraphs(F.col("t")).alias("p")).first()["p"]
    assert "".join(long) == "Twelve chars." * 64_000 and max(map(len, long)) <= 500


def test_metrics_against_joined_text(spark):
    import random

    rng = random.Random(5)
    texts = {c: ["".join(rng.choice(["。", " ", "x", "yy"]) for _ in range(rng.randrange(0, 5))) for _ in range(60)] for c in ("1_a", "2_b")}
    segments = spark.createDataFrame([(c, i << 19, t) for c, ts in texts.items() for i, t in enumerate(ts)], "config_name string, seq long, text string")
    runs = spark.createDataFrame([(c, "e", 1.0, None) for c in texts], "config_name string, engine string, duration_seconds double, error string")
    got = {r.config_name: (r.char_count, r.line_count, r.paragraph_count) for r in reports.transcript_metrics(segments, runs).collect()}
    assert got == {c: (len(" ".join(ts)), 60, sum(p.strip() != "" for p in " ".join(ts).split("。"))) for c, ts in texts.items()}


def test_infer_keeps_failures(spark):
    def respond(prompt):
        if "bad" in prompt:
            raise ValueError("no")
        return prompt.upper()

    got = rows(infer.infer(spark.createDataFrame([("a", "ok"), ("b", "bad")], "item_id string, prompt string"), respond), "item_id")
    assert got == [("a", "ok", "OK", None), ("b", "bad", None, "ValueError: no")]


def test_metrics_span_segments_and_ties(spark):
    segments = spark.createDataFrame([("1_a", 0, "x。y"), ("1_a", 1, "z。"), ("2_b", 0, "aaaa bbb")], "config_name string, seq int, text string")
    runs = spark.createDataFrame([("1_a", "e", 1.25, None), ("2_b", "e", 2.0, None), ("3_c", "e", 2.0, "broken")], "config_name string, engine string, duration_seconds double, error string")
    metrics = reports.transcript_metrics(segments, runs)
    assert [(r.char_count, r.line_count, r.paragraph_count) for r in metrics.orderBy("config_name").collect()] == [(6, 2, 2), (8, 1, 1), (0, 0, 0)]
    assert [r.chars for r in reports.eval_report(metrics).orderBy("number").collect()] == ["6", "8 ⭐", "0"]


def test_catalog_state_and_queue_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"code":0,"data":{"list":[{"bvid":"A","title":"t","duration":5,"owner":{"name":"n"}},{"title":"no id"}]}}')
    (tmp_path / "e.json").write_text('{"code":-1,"data":null}')
    assert [(r.item_id, r.url, r.author) for r in files.read_catalog(spark, str(tmp_path / "*.json"), "http://h/").collect()] == [("A", "http://h/A", "n")]
    (tmp_path / "s.txt").write_text('{"videos":{"A":{"status":"new","error":null},"B":{"title":"x"}}}')
    got = {r.item_id: (r.status, r.title, r.has_error) for r in files.read_state(spark, str(tmp_path / "s.txt")).collect()}
    assert got == {"A": ("new", None, True), "B": (None, "x", False)}
    (tmp_path / "bad.txt").write_text("{nope")
    assert files.read_state(spark, str(tmp_path / "bad.txt")).count() == 0 and files.read_queue(spark, str(tmp_path / "bad.txt")).count() == 0
    queue = spark.createDataFrame([(1, "b", "t", "u", 5, "n", 7), (0, "a", "t", "u", 5, "n", None)], "pos int, item_id string, title string, url string, duration_s int, author string, pubdate long")
    files.write_queue(queue, str(tmp_path / "q"))
    assert [(r.pos, r.item_id, r.pubdate) for r in files.read_queue(spark, str(tmp_path / "q" / "part*")).orderBy("pos").collect()] == [(0, "a", None), (1, "b", 7)]


def test_eval_lines(spark):
    lines = spark.createDataFrame([("p", "# engine: x"), ("p", "[0.0-1.5] hi"), ("p", "")], "path string, value string")
    assert rows(files.parse_eval_lines(lines), "start_s") == [("p", "engine", "x", None, None, None), ("p", None, None, 0.0, 1.5, "hi")]


def test_patterns_that_only_python_takes_are_ignored(spark):
    """Patterns are tested where they are matched; a bad one denies nothing and ends no job."""
    rows = spark.createDataFrame([("1", "an ad here", "u", 9, "x"), ("2", "fine", "u", 9, "x"), ("3", "BAD", "u", 9, "x")], "item_id string, title string, url string, duration_s int, author string")
    kept = rules.rule_filter(rows, rules.Rules(title_deny=["(?P<x>ad)", "[broken", " ", "(?i)bad", r"\p{Digit}+$"]))
    assert sorted(r.item_id for r in kept.collect()) == ["1", "2"]


def folded(rows, step):
    """Group numbers by a plain loop over one item's rows."""
    state, group, out = None, -1, []
    for row in rows:
        opens, state = step(state, *row)
        group += opens
        out.append(group)
    return out


def size_step(limit):
    return lambda s, n: (s is None or s + n > limit, n if s is None or s + n > limit else s + n)


def speaker_step(gap, span):
    def step(s, speaker, start, end):
        joins = s is not None and s[0] == speaker and start - s[2] <= gap and end - s[1] <= span
        return not joins, (speaker, s[1] if joins else start, end)

    return step


def number_step(most, seconds):
    def step(s, start, end):
        opens = s is None or s[0] >= most or s[1] + (end - start) > seconds
        return opens, (1, end - start) if opens else (s[0] + 1, s[1] + (end - start))

    return step


@pytest.mark.parametrize("width", [1, 2, 7, 1000])
def test_greedy_rules_against_loops(width):
    """Rules over batches of any width, with what is carried from batch to batch, give the rows of a fold."""
    rng = random.Random(width)
    items = [rng.randint(1, 60) for _ in range(30)]
    rows = [(item, k, rng.choice(["a", "b", None]), rng.uniform(0, 9), rng.randint(0, 30)) for item, n in enumerate(items) for k in range(n)]
    rows = [(i, k, who, 2.0 * k + x, 2.0 * k + x + rng.choice([0.1, 1.0, 5.0, 40.0]), n) for i, k, who, x, n in rows]
    column = lambda c: pa.array([r[c] for r in rows])
    for opens, columns, step in [
        (turns._by_size(50), (5,), size_step(50)), (turns._by_size(0), (5,), size_step(0)), (turns._by_speaker(3.0, 20.0), (2, 3, 4), speaker_step(3.0, 20.0)),
        (turns._by_speaker(50.0, 8.0), (2, 3, 4), speaker_step(50.0, 8.0)), (turns._by_number(3, 12.0), (3, 4), number_step(3, 12.0)), (turns._by_number(1000, 33.3), (3, 4), number_step(1000, 33.3)),
    ]:
        want = [g for i in range(len(items)) for g in folded([tuple(r[c] for c in columns) for r in rows if r[0] == i], step)]
        got, carried, last, group = [], None, None, 0
        for k in range(0, len(rows), width):
            part = rows[k : k + width]
            fresh = np.array([r[0] != (part[j - 1][0] if j else last) for j, r in enumerate(part)])
            flags, carried = opens([column(c).slice(k, width) for c in columns], fresh, None if fresh[0] else carried)
            for new, opened in zip(fresh, flags, strict=True):
                group = 0 if new else group + int(opened)
                got.append(group)
            last = part[-1][0]
        assert got == want


def test_groups_of_one_very_long_item(spark):
    """An item of a million turns and a document of 10 MB: by arithmetic, and in the order of rows."""
    n = 1_000_000
    long = spark.range(n).select(F.lit("x").alias("item_id"), F.col("id").cast("int").alias("seq"), F.lit(0.0).alias("start_s"), F.lit(1.0).alias("end_s"))
    sums = turns.batch_turns(long, 8, 240.0).agg(F.max("batch_no"), F.count_if(F.col("batch_no") != F.floor(F.col("seq") / 8)), F.count("*")).first()
    assert tuple(sums) == (n // 8 - 1, 0, n)
    text = spark.range(1).select(F.repeat(F.lit("abcdefghi."), n).alias("t"))
    paragraphs = text.select(turns.pack_paragraphs(F.col("t")).alias("p")).select(F.size("p"), F.size(F.array_distinct("p")), F.length(F.col("p")[0]))
    assert tuple(paragraphs.first()) == (n * 10 // 500, 1, 500)


def test_inference_goes_on_where_it_broke_off(spark, tmp_path):
    """Equal prompts are asked once; a run that is killed keeps the answers of its finished waves, and failures are asked again."""
    log = tmp_path / "calls"
    rows = spark.createDataFrame([(k, f"prompt {k % 20}") for k in range(60)] + [(99, None)], "item_id int, prompt string").repartition(3)

    def respond(kind):
        def answer(prompt, kind=kind, log=str(log)):
            with open(log, "a") as file:
                file.write(f"{prompt}\n")
            if kind == "dies" and prompt == "prompt 7":
                raise SystemExit(1)
            if kind != "works" and prompt == "prompt 3":
                raise ValueError("no")
            return prompt.upper()

        return answer

    calls = lambda: log.read_text().splitlines() if log.exists() else []
    with pytest.raises(Exception, match="(?i)fail|exit|abort"):
        infer.infer_once(rows, respond("dies"), str(tmp_path / "store"), waves=10).count()
    first = calls()
    assert len(first) == len(set(first)) < 20
    kept = {r.response for r in spark.read.schema(infer.ANSWERS).parquet(str(tmp_path / "store")).where("response IS NOT NULL").collect()}
    infer.infer_once(rows, respond("fails"), str(tmp_path / "store"), waves=3)
    second = calls()[len(first) :]
    assert sorted(second) == sorted(f"prompt {k}" for k in range(20) if f"PROMPT {k}" not in kept)
    found = infer.infer_once(rows, respond("works"), str(tmp_path / "store"), in_flight=1, waves=1).collect()
    assert calls()[len(first) + len(second) :] == ["prompt 3"]
    assert sorted((r.item_id, r.response, r.error) for r in found) == sorted([(k, f"PROMPT {k % 20}", None) for k in range(60)] + [(99, None, None)], key=lambda r: r[0])


def test_texts_at_their_places(spark, tmp_path):
    """Clashes go to the first by pos; a failed job leaves nothing behind."""
    out = str(tmp_path / "out")
    rows = [(2, "a/x.md", "late"), (1, "a/x.md", "early ü"), (3, "b.md", ""), (4, "c/d/e.md", None)]
    files.write_texts(spark.createDataFrame(rows, "pos long, path string, md string").repartition(3), out)
    found = {str(p.relative_to(out)): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    assert found == {"a/x.md": "early ü", "b.md": "", "c/d/e.md": ""}
    bad = spark.range(20).select(F.col("id").alias("pos"), F.format_string("f%d.md", "id").alias("path"), F.when(F.col("id") == 19, F.raise_error(F.lit("killed")).cast("string")).otherwise("text").alias("md"))
    with pytest.raises(Exception, match="killed"):
        files.write_texts(bad, str(tmp_path / "bad"))
    assert not [p for p in (tmp_path / "bad").rglob("*") if p.is_file()]


def test_entries_keep_unknown_keys(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"videos": {"a\\"b": {"status": "new", "tags": ["x", 1], "error": null, "deep": {"k": null}}, "c": {}}, "version": 3}')
    (tmp_path / "t.json").write_text("not json")
    entries = files.read_entries(spark, str(tmp_path / "*.json"))
    updates = spark.createDataFrame([('a"b', 1, {"status": "x"}), ('a"b', 2, {"status": "y", "note": None}), ("d", 1, {}), ("e", 1, {"status": "z"})], "item_id string, seq long, fields map<string,string>")
    files.write_entries(files.upsert_entries(entries, updates), str(tmp_path / "out"), 2)
    got = {r.item_id: json.loads(r.j) for r in files.read_entries(spark, str(tmp_path / "out")).select("item_id", F.to_json("entry").alias("j")).collect()}
    assert got == {'a"b': {"status": "y", "tags": ["x", 1], "error": None, "deep": {"k": None}, "note": None}, "c": {}, "d": {}, "e": {"status": "z"}}
    e = F.col("entry")
    row = files.read_entries(spark, str(tmp_path / "out")).where(F.col("item_id") == 'a"b').select(files.entry_value(e, "error").alias("error"), files.entry_has(e, "error").alias("given"), files.entry_has(e, "absent").alias("absent")).first()
    assert tuple(row) == (None, True, False)


def test_merge_rewrites_only_named_buckets(spark, tmp_path):
    """Equal to the upsert of the whole state; other buckets keep their files, and the state is not shuffled."""
    path = str(tmp_path / "state")
    known = spark.createDataFrame([(f"i{k}", "old", None if k % 2 else "e") for k in range(200)], "item_id string, status string, error string")
    updates = spark.createDataFrame([("i3", 1, {"status": "x"}), ("i3", 2, {"error": None}), ("i4", 1, {"error": None}), ("fresh", 1, {"status": "y"}), ("bare", 1, {})], "item_id string, seq long, fields map<string,string>")
    state.save_state(known, path, 32)
    files_of = lambda: {str(p.relative_to(path)) for p in (tmp_path / "state").rglob("*.parquet")}
    before = files_of()
    touched = state.merge_state(spark, path, updates, ["status", "error"], 32)
    assert 1 <= len(touched) <= 4
    of_touched = lambda names: {n for n in names if int(n.split("/")[0].removeprefix("bucket=")) in touched}
    assert before - of_touched(before) == files_of() - of_touched(files_of()) and before != files_of()
    got = spark.read.parquet(path).select("item_id", "status", "error")
    want = state.upsert_state(known, updates, ["status", "error"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    given = spark.createDataFrame([("i3", {"status": "x"})], "item_id string, given map<string,string>")
    plan = state.merge_plan(spark.read.parquet(path).drop("bucket"), given, ["status", "error"], True)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter, (item_id" in plan and "strategy=broadcast" in plan


@pytest.mark.parametrize("span", [2, 3, 1 << 20])
def test_counting_over_sparse_positions(spark, span):
    rng = random.Random(span)
    rows = [(p, rng.random() < 0.4) for p in rng.sample(range(-40, 10**6), 200)]
    got = state.counted_before(spark.createDataFrame(rows, "pos long, hit boolean").repartition(3), F.col("hit"), span=span)
    n, want = 0, {}
    for p, hit in sorted(rows):
        want[p] = n
        n += hit
    assert {r.pos: r.before for r in got.collect()} == want


def test_turns_that_go_on_after_the_probe(spark):
    spoken = [("one", 0, "A", 0.0), ("one", 1, "A", 500.0), ("late", 0, "A", 0.0), ("late", 1, "B", 120.0), ("short", 0, "A", 0.0), ("short", 1, "B", 119.0), ("long", 0, "A", 0.0), ("long", 1, "B", 10.0), ("long", 2, "B", 900.0), ("unknown", 0, "A", 0.0), ("unknown", 1, "B", 1.0)]
    frame = spark.createDataFrame(spoken, "item_id string, seq int, speaker string, start_s double")
    durations = spark.createDataFrame([("one", 600.0), ("late", 130.0), ("short", 120.0), ("long", 1000.0)], "item_id string, duration_s double")
    got = rows(turns.diarized_turns(frame, durations).select("item_id", "seq", "reused"), "item_id", "seq")
    assert got == [("long", 0, False), ("long", 1, False), ("long", 2, False), ("short", 0, True), ("short", 1, True)]
    assert turns.diarized_turns(frame.where("false"), durations).count() == 0


def test_plain_transcripts(spark):
    items = spark.createDataFrame([("a", "T", "U"), ("b", "T", None), ("c", "T", "")], "item_id string, title string, author string")
    segments = spark.createDataFrame([("a", 1, "y" * 300), ("a", 0, " " + "x" * 300), ("b", 0, "z"), ("b", 1, None), ("c", 0, " ")], "item_id string, seq int, text string")
    got = dict(rows(turns.render_plain(items, segments)))
    assert got["a"] == "# T\n\n**UP主**: U\n\n---\n\n" + "x" * 300 + "\n\n" + "y" * 300 + "\n"
    assert got["b"] == "# T\n\n---\n\nz\n"
    assert got["c"] == "# T\n\n**UP主**: \n\n---\n\n(转录失败或无文字内容)"


def test_report_as_a_text(spark):
    schema = "config_name string, engine string, char_count long, line_count long, paragraph_count long, duration_seconds double, error string"
    metrics = spark.createDataFrame([("2_b", "e", 0, 0, 0, 1.0, "x" * 40), ("1_a", "e", 9, 1, 2, 12345678.5, None), ("3_c", "f", 9, 1, 2, 0.0, None)], schema)
    (text,) = rows(reports.report_text(metrics, "v", F.lit("now"), [("1_a", ["- d"])]))[0]
    lines = text.split("\n")
    assert [x for x in lines if x.startswith("| ")][1:] == ["| 1 | 1_a | e | 9 ⭐ | 2 | 12345678.5 | ✅ |", "| 2 | 2_b | e | 0 | 0 | 1.0 | ❌ " + "x" * 30 + " |", "| 3 | 3_c | f | 9 ⭐ | 2 | 0.0 | ✅ |"]
    assert lines[2:4] == ["**测试视频**: v", "**测试时间**: now"] and lines[-3:] == ["### 1_a", "- d", ""]
