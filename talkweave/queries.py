"""The registered queries of the transcript operators; their SQL is in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave import schemas as S
from talkweave.functions import lookup
from talkweave.functions import text as X
from talkweave.operators import infer, publish, reports, rules, state, turns
from talkweave.oracles import ORACLES  # noqa: F401
from talkweave.plans import bindings as B
from talkweave.sources import files, shared
from talkweave.streaming import jobs

FLAGSHIP = "queue_status"
#: Rows of one written text file: whole files are read as one row each.
FILE_ROWS = 1000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _docs(s: SparkSession, d: str) -> DataFrame:
    return B.table(s, d, "documents")


@query
def queue_status(s, d):
    kept = rules.rule_filter(B.catalog(s, d), B.RULES)
    queue, _ = state.build_queue(kept, B.current(s, d), 1 << 40)
    return reports.status_counts(queue)


@query
def rule_filter(s, d):
    return rules.rule_filter(B.catalog(s, d), B.RULES).select("item_id", "title", "author", "duration_s")


@query
def drop_reasons(s, d):
    return rules.drop_reason(B.catalog(s, d), B.RULES).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query
def upsert_state(s, d):
    empty = B.current(s, d).where("false").select("item_id", "status", F.lit(None).cast("string").alias("error"))
    log = B.log(s, d)
    given = F.create_map(F.lit("status"), F.col("status"))
    with_error = F.create_map(F.lit("status"), F.col("status"), F.lit("error"), F.when(F.col("status") == "error", "failed"))
    updates = log.select("item_id", "seq", F.when(F.col("status").isin("error", "new"), with_error).otherwise(given).alias("fields"))
    return state.upsert_state(empty, updates, ["status", "error"])


@query
def merged_state(s, d):
    """The same updates in three lots, each merged into the buckets of a saved state that it names."""
    path = shared.fresh_folder(s, "buckets")
    state.save_state(B.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("item_id"), F.lit("known").alias("status"), F.lit("old").alias("error")), path, 16)
    given = F.create_map(F.lit("status"), F.col("status"))
    with_error = F.create_map(F.lit("status"), F.col("status"), F.lit("error"), F.when(F.col("status") == "error", "failed"))
    updates = B.log(s, d).select("item_id", "seq", "ts", F.when(F.col("status").isin("error", "new"), with_error).otherwise(given).alias("fields"))
    ends = [r[0] for r in updates.select(F.percentile_approx("ts", F.array(F.lit(0.4), F.lit(0.7))).alias("e")).select(F.explode("e")).collect()]
    for low, high in zip([None, *ends], [*ends, None], strict=True):
        lot = updates.where((F.lit(True) if low is None else F.col("ts") > low) & (F.lit(True) if high is None else F.col("ts") <= high))
        state.merge_state(s, path, lot.drop("ts"), ["status", "error"], 16)
    return s.read.parquet(path).select("item_id", "status", "error")


@query
def lookup_status(s, d):
    return state.lookup_status(B.catalog(s, d).select("item_id"), B.current(s, d))


@query
def status_counts(s, d):
    return reports.status_counts(state.fold_updates(B.log(s, d).select("item_id", "seq", F.col("status").alias("value"))))


@query
def transition_audit(s, d):
    return state.status_transition_audit(B.log(s, d))


@query
def mark_seen(s, d):
    before = B.current(s, d).select("item_id", "status", F.lit("then").alias("first_seen"), F.lit("then").alias("last_seen"), F.lit(7).cast("long").alias("pubdate"))
    seen = B.catalog(s, d).select("item_id", F.when(F.col("pos") % 3 == 0, F.col("pubdate")).alias("pubdate"))
    return state.mark_seen(before, seen, F.lit("now"))


@query
def build_queue(s, d):
    queue, seen = state.build_queue(B.catalog(s, d), B.current(s, d), 50)
    return seen.select("item_id").join(queue.select("item_id", "status", F.lit(True).alias("queued")), "item_id", "left").select("item_id", "status", F.coalesce("queued", F.lit(False)).alias("queued"))


@query
def capped_scan(s, d):
    rows = state.lookup_status(B.catalog(s, d).select("pos", "item_id"), B.current(s, d))
    return state.capped_scan(rows, F.col("status") == "downloaded", 20).select("pos", "item_id", "status")


@query
def stage_worklist(s, d):
    states = B.current(s, d).withColumn("transcript_md", F.concat(F.lit("media/"), F.col("item_id"), F.lit(".m4a")))
    return state.stage_worklist(B.catalog(s, d).select("pos", "item_id"), states, "llm", B.present(s, d)).select("pos", "item_id", "status")


@query
def prioritize_current_run(s, d):
    ready = state.lookup_status(B.catalog(s, d).select("pos", "item_id"), B.current(s, d)).where("status = 'uploaded'")
    return state.prioritize_current_run(ready, B.toxic(s, d)).select("pos", "item_id", "current")


@query
def touched_set(s, d):
    ids = B.current(s, d)
    return state.touched_set([ids.where("status = 'downloaded'"), ids.where("status = 'error'")], B.toxic(s, d))


@query
def recover_state(s, d):
    states = B.current(s, d).select("item_id", "status", F.concat(F.lit("media/"), F.col("item_id"), F.lit(".m4a")).alias("audio_path"), F.when(F.col("status") == "error", "failed").alias("error"))
    return state.recover_state(states, B.present(s, d)).select("item_id", "status", "error", "changed")


@query
def reset_unfinished(s, d):
    states = B.current(s, d).select("item_id", "status", F.when(F.col("status") == "error", "failed").alias("error"))
    return state.reset_unfinished(states).select("item_id", "status", "error", "changed")


@query
def artifact_pairs(s, d):
    rows = B.current(s, d).select("item_id", F.concat(F.lit("media/"), F.col("item_id"), F.lit(".m4a")).alias("path"))
    there, gone = (state.with_artifacts(rows, B.present(s, d), "path", e) for e in (True, False))
    return there.select("item_id", F.lit(True).alias("there")).unionByName(gone.select("item_id", F.lit(False).alias("there")))


@query
def match_artifact(s, d):
    files = B.present(s, d).withColumn("path", F.when(F.length("path") % 2 == 0, F.regexp_replace("path", "m4a$", "webm")).otherwise(F.col("path")))
    return state.match_artifact(B.catalog(s, d).select(F.col("item_id").alias("stem")), files)


@query
def ai_decision_filter(s, d):
    return rules.ai_decision_filter(B.catalog(s, d).select("pos", "item_id"), B.current(s, d), B.toxic(s, d).dropDuplicates(["item_id"]), 200).select("item_id", "skip")


@query
def download_plan(s, d):
    return rules.download_plan(B.catalog(s, d))


@query
def publish_source(s, d):
    paths = _docs(s, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("s/"), F.col("source"))).when(F.col("doc_id") % 3 == 1, "").alias("summary_md"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("t/"), F.col("source"))).alias("transcript_md"))
    return rules.publish_source(paths).select("doc_id", "source_path")


@query
def detect_language(s, d):
    n = (F.col("n_chars") / 2).cast("int")
    mixed = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("中"), n)).when(F.col("doc_id") % 3 == 1, F.repeat(F.lit("の"), n)).otherwise(""))
    return _docs(s, d).select("doc_id", X.detect_language(mixed).alias("language"))


@query
def strip_hallucinations(s, d):
    mixed = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("  谢谢收看"), F.col("text"), F.lit("\n \n \n感谢收看 end"))).otherwise(F.col("text"))
    clean = X.strip_hallucinations(mixed)
    return _docs(s, d).select("doc_id", F.length(clean).alias("n"), F.md5(clean.cast("binary")).alias("digest"))


@query
def strip_think(s, d):
    mixed = F.concat(F.lit(" <think>a\nb</think>"), F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.lit(" <think>open")).otherwise(""))
    return _docs(s, d).select("doc_id", F.md5(X.strip_think(mixed).cast("binary")).alias("digest"))


@query
def safe_filename(s, d):
    return _docs(s, d).select("doc_id", X.safe_filename(F.col("text")).alias("name"))


@query
def extract_title(s, d):
    md = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n# "), F.col("source"), F.lit(" \n"), F.col("text"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("\n \n"), F.col("text"))).otherwise("")
    return _docs(s, d).select("doc_id", X.extract_title(md, F.col("doc_id").cast("string")).alias("title"))


@query
def extract_body(s, d):
    md = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# t\n\n--- x\n\n"), F.col("text"), F.lit("\n---\n"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" ---"), F.col("source"))).otherwise(F.concat(F.lit(" "), F.col("text")))
    body = X.extract_body(md)
    return _docs(s, d).select("doc_id", F.length(body).alias("n"), F.md5(body.cast("binary")).alias("digest"))


@query
def inject_pub_line(s, d):
    kind = F.col("doc_id") % 3
    md = F.when(kind == 0, F.concat(F.lit("# "), F.col("source"), F.lit("\nUP主：a\n"), F.col("text"))).when(kind == 1, F.concat(F.lit("x\n# "), F.col("source"), F.lit(" more\n"), F.col("text"))).otherwise(F.col("text"))
    out = X.inject_pub_line(md, F.col("source"), X.format_pub_time(F.lit(1_700_000_000) + F.col("doc_id")))
    return _docs(s, d).select("doc_id", F.md5(out.cast("binary")).alias("digest"))


@query
def format_timestamp(s, d):
    return _docs(s, d).select("doc_id", X.format_timestamp(F.col("n_chars") + 0.75).alias("stamp"), X.timestamped_line(F.col("doc_id"), F.col("n_chars"), F.col("source"), True).alias("line"))


@query
def accept_correction(s, d):
    cut = lambda share: F.substring(F.col("text"), F.lit(1), (F.length("text") * share).cast("int"))
    share = (F.col("doc_id") % 10) / 10
    rows = _docs(s, d).select("doc_id", X.accept_chunk(F.col("text"), cut(share)).alias("c"), X.accept_paragraph(F.col("text"), cut(share)).alias("p"))
    md5 = lambda c: F.md5(F.col(c).cast("binary"))
    return rows.select("doc_id", F.length("c").alias("chunk"), F.length("p").alias("paragraph"), md5("c").alias("chunk_digest"), md5("p").alias("paragraph_digest"))


@query
def split_sentences(s, d):
    return _docs(s, d).select("doc_id", F.posexplode(turns.split_sentences(F.col("text"))).alias("seq", "sentence")).select("doc_id", "seq", F.md5(F.col("sentence").cast("binary")).alias("digest"))


@query
def pack_paragraphs(s, d):
    return _docs(s, d).select("doc_id", F.posexplode(turns.pack_paragraphs(F.col("text"))).alias("seq", "p")).select("doc_id", "seq", F.length("p").alias("n"), F.md5(F.col("p").cast("binary")).alias("digest"))


@query
def pack_chunks(s, d):
    return _docs(s, d).select("doc_id", F.posexplode(turns.pack_chunks(F.col("text"))).alias("chunk_no", "c")).select("doc_id", "chunk_no", F.length("c").alias("n"), F.md5(F.col("c").cast("binary")).alias("digest"))


@query
def pack_segments(s, d):
    return turns.pack_segments(B.speech(s, d), ["item_id"]).select("item_id", F.col("paragraph_no").alias("seq"), F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query
def speaker_stats(s, d):
    return turns.speaker_stats(B.speech(s, d)).withColumn("share", F.round("share", 6))


@query
def significant_speakers(s, d):
    return turns.significant_speakers(turns.speaker_stats(B.speech(s, d)), 0.3, 2000).select("item_id", "speaker", "prominent", "significant")


@query
def relabel_insignificant(s, d):
    speech = B.speech(s, d)
    return turns.relabel_insignificant(speech, turns.significant_speakers(turns.speaker_stats(speech), 0.3, 2000)).select("item_id", "seq", "effective")


@query
def speaker_blocks(s, d):
    rows = turns.speaker_blocks(B.speech(s, d).withColumn("effective", F.when(F.col("speaker") == "system", "user").otherwise(F.col("speaker"))))
    return rows.select("item_id", F.col("block").cast("long").alias("block"), "speaker", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query
def speaker_labels(s, d):
    return turns.speaker_labels(B.speech(s, d))


@query
def merge_turns(s, d):
    rows = B.intervals(s, d)
    rows = rows.withColumn("seq", F.row_number().over(turns.Window.partitionBy("item_id").orderBy("start_s", "seq")))
    return turns.merge_turns(rows, 300.0, 500.0).select("item_id", "seq", "speaker", F.round("start_s", 4).alias("start_s"), F.round("end_s", 4).alias("end_s"), "n_turns")


@query
def batch_turns(s, d):
    return turns.batch_turns(B.intervals(s, d).withColumns({"start_s": F.lit(0.0), "end_s": F.round(F.col("end_s") - F.col("start_s"), 2)})).select("item_id", "seq", "batch_no")


@query
def assign_speakers(s, d):
    rows = B.intervals(s, d)
    return turns.assign_speakers(rows.where("speaker = 'error'"), rows.where("speaker <> 'error'"), 100.0).select("item_id", "seq", "speaker")


@query
def plan_chunks(s, d):
    return turns.plan_chunks(B.catalog(s, d).select("item_id", "duration_s"))


@query
def speaker_probe(s, d):
    rows = B.intervals(s, d)
    first = F.min("start_s").over(turns.Window.partitionBy("item_id"))
    rows = rows.withColumn("start_s", F.col("start_s") - first)
    return turns.speaker_probe(rows, rows.groupBy("item_id").agg(F.max("start_s").alias("duration_s")))


@query
def diarized_turns(s, d):
    rows = B.intervals(s, d)
    rows = rows.withColumn("start_s", F.col("start_s") - F.min("start_s").over(turns.Window.partitionBy("item_id")))
    return turns.diarized_turns(rows, rows.groupBy("item_id").agg(F.max("start_s").alias("duration_s")), 720.0).select("item_id", "seq", "speaker", "reused")


@query
def speaker_map(s, d):
    answer = F.concat(F.lit('so: {"[说话人 A]": "'), F.col("role"), F.lit('", "B ": "NULL", "[C]": " x ", "D": null} done'))
    rows = B.table(s, d, "conversations").select("conv_id", "turn", X.normalise_speaker_map(answer, F.lit("user")).alias("m"))
    return rows.select("conv_id", "turn", F.col("m")["说话人A"].alias("a"), F.col("m")["C"].alias("c"), F.size("m").alias("n"), X.speaker_info_text(F.col("m")).alias("info"))


@query
def replaced_tags(s, d):
    md = F.concat(F.lit("**[说话人 A]** **[说话人 A]** "), F.col("text"), F.lit(" **SPEAKER_B**: x **[SPEAKER_B]** y **说话人　A** z"))
    names = F.create_map(F.lit("说话人A"), F.concat(F.lit("$1\\"), F.col("role")), F.lit("SPEAKER_B"), F.lit("Bo"))
    return B.table(s, d, "conversations").select("conv_id", "turn", X.replace_speaker_tags(X.collapse_repeated_tags(md), names).alias("text"))


def _marked(text: Column) -> Column:
    """Whole texts with every fifth line as a heading, indented bullet, bullet, quote or rule."""
    plain = F.translate(text, "*_`[]()#", "")
    line = F.transform(F.split(plain, "\n"), lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("## "), x)).when(i % 5 == 1, F.concat(F.lit("  - "), x)).when(i % 5 == 2, F.concat(F.lit("* "), x)).when(i % 5 == 3, F.concat(F.lit("\t> "), x)).otherwise(x))
    return F.array_join(line, "\n")


@query
def markdown_blocks(s, d):
    docs = _docs(s, d).select(F.col("doc_id").alias("item_id"), _marked(F.col("text")).alias("md"))
    return publish.markdown_blocks(docs).select("item_id", "line_no", "kind", "level", F.md5(F.col("text").cast("binary")).alias("digest"), "run")


@query
def rendered_xhtml(s, d):
    docs = _docs(s, d).select("doc_id", _marked(F.col("text")).alias("md"))
    return publish.render_xhtml(docs).select("doc_id", F.length("xhtml").alias("n"), F.md5(F.col("xhtml").cast("binary")).alias("digest"))


@query
def inline_html(s, d):
    plain = F.translate("text", "*_`[]()#", "")
    md = F.concat(F.lit("**"), F.col("source"), F.lit("** `cd` [a_b](u_v_w) _i_ "), plain)
    return _docs(s, d).select("doc_id", F.md5(publish.inline_html(md).cast("binary")).alias("digest"))


@query
def book_table(s, d):
    docs = _docs(s, d)
    path = F.concat(F.lit("t/"), F.col("doc_id").cast("string"))
    states = docs.select(F.col("doc_id").cast("string").alias("item_id"), F.when(F.col("doc_id") % 4 == 0, "uploaded").otherwise("summarized").alias("status"), (F.lit(1_700_000_000) + F.col("doc_id")).alias("pubdate"), path.alias("transcript_md"), F.lit("").alias("summary_md"))
    files = docs.where("doc_id % 10 <> 1").select(path.alias("path"), F.concat(F.lit("# "), F.col("source"), F.lit("\n"), _marked(F.col("text"))).alias("md"))
    return publish.book_table(states, files).select("item_id", "title", "pub_time", "path", "outcome", F.md5(F.col("xhtml").cast("binary")).alias("digest"))


@query
def stage_documents(s, d):
    body = F.col("text")
    docs = _docs(s, d).select("doc_id", publish.corrected_markdown(F.col("source"), F.col("lang"), body).alias("c"), publish.final_markdown(F.col("source"), F.col("lang"), F.lit("s"), body).alias("f"))
    return docs.select("doc_id", F.md5(F.col("c").cast("binary")).alias("corrected"), F.md5(F.col("f").cast("binary")).alias("final"))


@query
def stale_paths(s, d):
    books = B.catalog(s, d).select("item_id", F.concat(X.safe_filename(F.col("title")), F.lit(".epub")).alias("path"), F.when(F.col("pos") % 2 == 0, F.concat(F.lit("out/"), F.col("item_id"), F.lit(".epub"))).otherwise("out/x.epub").alias("epub_path"))
    return publish.stale_paths(books)


@query
def path_conflicts(s, d):
    books = B.catalog(s, d).select("pos", "item_id", F.concat(X.safe_filename(F.col("title")), F.lit(".epub")).alias("path"))
    return publish.path_conflicts(books).select("item_id", "n_items", "wins")


@query
def stage_stats(s, d):
    rows = state.lookup_status(B.catalog(s, d).select("item_id"), B.current(s, d))
    done, ok, file = F.col("status") == "uploaded", F.col("status") != "error", F.col("status") != "new"
    each = [rows.select(F.lit(stage).alias("stage"), state.stage_outcome(stage, done, file, ok).alias("outcomes")) for stage in ("download", "transcribe", "llm", "upload")]
    return reports.stage_stats(each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3]))


@query
def filter_publish_stats(s, d):
    rows = state.lookup_status(B.catalog(s, d).select("item_id"), B.current(s, d))
    decided = F.when(F.col("status") != "error", F.col("status") == "uploaded")
    file, ok = F.col("status") != "new", F.col("status") != "error"
    each = [rows.select(F.lit(stage).alias("stage"), state.stage_outcome(stage, F.lit(False), file, yes).alias("outcomes")) for stage, yes in (("filter", decided), ("publish", ok))]
    return reports.stage_stats(each[0].unionByName(each[1]))


@query
def run_success(s, d):
    return reports.run_success(B.catalog(s, d), B.current(s, d), 100)


@query
def recent_uploads(s, d):
    rows = B.current(s, d).select("item_id", "status", "last_attempt", F.col("item_id").cast("int").alias("pos"), F.lit(None).cast("string").alias("title"))
    return reports.recent_uploads(rows).select("item_id", "title")


@query
def file_counts(s, d):
    return reports.file_counts(_docs(s, d).select(F.concat(F.lit("a.b/"), F.col("source"), F.lit("."), F.col("lang")).alias("path")))


@query
def queue_preview(s, d):
    return reports.queue_preview(B.catalog(s, d))


def _lines(docs: DataFrame) -> DataFrame:
    """Every line of every document as a segment of its language's config, in order of document and line."""
    rows = docs.select(F.concat(F.lit("1_"), F.col("lang")).alias("config_name"), "doc_id", F.posexplode(F.split(F.replace("text", F.lit("."), F.lit("。")), "\n")).alias("line", "text"))
    return rows.select("config_name", F.shiftleft("doc_id", 28).bitwiseOR(F.col("line")).alias("seq"), "text")


@query
def transcript_metrics(s, d):
    docs = _docs(s, d)
    runs = docs.groupBy(F.concat(F.lit("1_"), F.col("lang")).alias("config_name")).agg(F.lit("e").alias("engine"), (F.sum("n_chars") / 7.0).alias("duration_seconds"), F.when(F.min("lang") == "de", "it broke in the middle of everything").alias("error"))
    return reports.transcript_metrics(_lines(docs), runs)


@query
def eval_report(s, d):
    return reports.eval_report(transcript_metrics(s, d))


@query
def report_text(s, d):
    return reports.report_text(transcript_metrics(s, d), "documents", F.lit("2024-01-01 00:00:00"), [("1_de", ["- d", "- e"]), ("1_en", [])])


def _spoken(s: SparkSession, d: str) -> DataFrame:
    """Conversations as documents of tagged lines."""
    talk = B.speech(s, d).withColumn("line", F.concat(F.lit("**[说话人 A]** "), F.col("text")))
    return talk.groupBy("item_id").agg(F.array_join(turns.ordered("seq", "line"), "\n").alias("body"), F.lit("t").alias("title"), F.lit("a").alias("author"), F.lit("en").alias("language"), F.create_map(F.lit("说话人A"), F.lit("Ann")).alias("names"))


TEMPLATE = "Title {title} by {author}: {text}"


@query
def corrected_documents(s, d):
    docs = _spoken(s, d)
    answered = infer.infer(infer.chunk_requests(docs, TEMPLATE), _echo)
    return infer.correct_documents(docs, answered).select("item_id", F.length("corrected").alias("n"), F.md5(F.col("corrected").cast("binary")).alias("digest"))


@query
def stitched_responses(s, d):
    requests = infer.chunk_requests(_spoken(s, d), TEMPLATE)
    stored = requests.where("chunk_no % 2 = 0").select("item_id", "chunk_no", F.lower("chunk_text").alias("response"), F.lit(None).cast("string").alias("error"))
    return infer.stitch(requests.select("item_id", "chunk_no"), stored).select("item_id", "chunk_no", F.md5(F.col("response").cast("binary")).alias("digest"))


@query
def process_transcripts(s, d):
    done = infer.process_transcripts(_spoken(s, d), _echo, TEMPLATE, "Sum {title}: {text}")
    return done.select("item_id", "title", "author", F.md5(F.col("corrected").cast("binary")).alias("corrected"), F.md5(F.col("summary").cast("binary")).alias("summary"))


@query
def summarize_documents(s, d):
    docs = _docs(s, d).select(F.col("doc_id").alias("item_id"), F.col("source").alias("title"), F.col("lang").alias("author"), F.col("text").alias("corrected"))
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<think>x</think>"), F.col("text"))).otherwise(F.col("source"))
    error = F.when(F.col("doc_id") % 7 == 0, "read timeout").when(F.col("doc_id") % 7 == 1, "boom")
    answered = _docs(s, d).select(F.col("doc_id").alias("item_id"), F.when(error.isNull(), answer).alias("response"), error.alias("error"))
    out = infer.summarize_documents(docs, answered)
    return out.select("item_id", "is_short", "is_error", F.md5(F.col("summary").cast("binary")).alias("summary"), F.md5(F.col("final_md").cast("binary")).alias("final"))


@query
def filter_requests(s, d):
    asked = infer.filter_requests(B.catalog(s, d), "Keep {title} of {author}?")
    given = F.from_json("body", "model string, prompt string, stream boolean, options struct<temperature double, num_predict int>")
    return asked.select("item_id", F.md5(F.col("prompt").cast("binary")).alias("prompt"), given.alias("b")).select("item_id", "prompt", F.md5(F.col("b.prompt").cast("binary")).alias("sent"), "b.options.temperature", "b.options.num_predict")


@query
def speaker_requests(s, d):
    docs = _docs(s, d).select(F.col("doc_id").alias("item_id"), F.lit("").alias("title"), F.col("source").alias("author"), F.col("text").alias("body"))
    return infer.speaker_requests(docs, "{title} {author} {text}").select("item_id", F.md5(F.col("prompt").cast("binary")).alias("prompt"))


@query
def response_texts(s, d):
    body = F.to_json(F.struct(F.concat(F.lit(" <think>a\n</think> "), F.col("text")).alias("response")))
    return _docs(s, d).select("doc_id", F.md5(X.response_text(body).cast("binary")).alias("digest"))


@query
def languages(s, d):
    own = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("lang"))
    text = F.col("text")
    return _docs(s, d).select("doc_id", X.language_of_item(None, text).alias("detected"), X.language_of_item("ja", text).alias("configured"), X.language_of_item(None, text, own, "zh").alias("reported"), X.needs_bilingual(own, True).alias("batched"), X.needs_bilingual(own, False).alias("single"))


@query
def simplified(s, d):
    text = F.concat(F.lit("說話頭髮發現發"), F.col("text"), F.lit("頭發現"))
    out = X.to_simplified(text, {"說": "说", "話": "话", "發": "发", "頭": "头", "e": "é"}, {"頭髮": "头发", "發現": "发现了", "發": "X"})
    return _docs(s, d).select("doc_id", F.md5(out.cast("binary")).alias("digest"))


@query
def parsed_times(s, d):
    text = F.when(F.col("event_id") % 3 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return B.table(s, d, "events").select("event_id", F.unix_seconds(X.parse_iso(text)).alias("seconds"))


@query
def stamped_lines(s, d):
    rows = B.intervals(s, d).withColumns({"start_s": F.col("seq").cast("double"), "end_s": F.col("seq") + 4000.5})
    return turns.timestamped_lines(rows).select("item_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query
def id_labels(s, d):
    raw = F.when(F.col("doc_id") % 4 == 0, F.col("source")).otherwise(F.format_string("SPEAKER_%02d", "doc_id"))
    return _docs(s, d).select("doc_id", X.id_label(raw).alias("label"))


@query
def unchecked_tails(s, d):
    rows = _docs(s, d).select("doc_id", F.posexplode(turns.pack_paragraphs(F.concat("text", F.lit(" and a tail without an end")), check_tail=False)).alias("seq", "p"))
    return rows.select("doc_id", "seq", F.length("p").alias("n"), F.md5(F.col("p").cast("binary")).alias("digest"))


@query
def rendered_transcripts(s, d):
    items = B.table(s, d, "conversations").select(F.col("conv_id").cast("string").alias("item_id"), F.concat(F.lit("T"), F.col("conv_id")).alias("title"), F.lit("U").alias("author")).distinct()
    return turns.render_transcript(items, B.speech(s, d)).select("item_id", F.md5(F.col("md").cast("binary")).alias("digest"))


def _titled(s: SparkSession, d: str) -> DataFrame:
    """The conversations as items; every other one has an author."""
    ids = B.table(s, d, "conversations").select("conv_id").distinct()
    return ids.select(F.col("conv_id").cast("string").alias("item_id"), F.concat(F.lit("T"), F.col("conv_id")).alias("title"), F.when(F.col("conv_id") % 2 == 0, "U").otherwise("").alias("author"))


@query
def rendered_with_ids(s, d):
    said = B.speech(s, d).withColumn("speaker", F.when(F.col("speaker") == "user", "SPEAKER_00").otherwise(F.col("speaker")))
    return turns.render_transcript(_titled(s, d), said, "whisperx").select("item_id", F.md5(F.col("md").cast("binary")).alias("digest"))


@query
def rendered_plain(s, d):
    said = B.speech(s, d).where(F.col("item_id").cast("long") % 3 != 0)
    return turns.render_plain(_titled(s, d), said).select("item_id", F.md5(F.col("md").cast("binary")).alias("digest"))


@query
def named_turns(s, d):
    speech = B.speech(s, d)
    names = speech.select("item_id").distinct().select("item_id", F.create_map(F.lit("user"), F.concat(F.lit("Ann "), F.col("item_id"))).alias("names"))
    return turns.with_names(speech, names).select("item_id", "seq", "name")


@query
def filled_turns(s, d):
    rows = B.speech(s, d).withColumn("text", F.when(F.col("seq") % 3 == 0, " \u3000\n").when(F.col("seq") % 7 == 0, F.lit(None)).otherwise(F.col("text")))
    return rules.drop_empty_turns(rows).select("item_id", "seq")


@query
def required_fields(s, d):
    rows = B.catalog(s, d).withColumn("url", F.when(F.col("pos") % 5 == 0, "").otherwise(F.col("url")))
    return rules.drop_reason(rows, rules.Rules(keep_when_uncertain=False)).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query
def state_selections(s, d):
    states = B.current(s, d).withColumns({"summary_md": F.when(F.col("item_id").cast("int") % 3 == 0, "s").when(F.col("item_id").cast("int") % 3 == 1, ""), "transcript_md": F.when(F.col("item_id").cast("int") % 2 == 0, "t")})
    picked = {"pending": rules.pending_items(states, "downloaded"), "summaries": rules.with_summaries(states), "transcripts": rules.with_transcripts(states)}
    first, *rest = [f.select(F.lit(k).alias("selection"), "item_id") for k, f in picked.items()]
    return first.unionByName(rest[0]).unionByName(rest[1])


@query
def catalog_to_queue(s, d):
    return rules.catalog_to_queue(B.catalog(s, d))


@query
def applied_outcomes(s, d):
    states = B.current(s, d).select("item_id", "status", F.lit(None).cast("string").alias("error"))
    log = B.log(s, d)
    kind = {"new": ("download", "started"), "downloaded": ("download", "downloaded"), "transcript_ready": ("transcribe", "error"), "uploaded": ("upload", "uploaded"), "error": ("llm", "error")}
    of = lambda i: F.create_map(*[F.lit(x) for k, v in kind.items() for x in (k, v[i])])[F.col("status")]
    outcomes = log.select("item_id", "seq", of(0).alias("stage"), of(1).alias("outcome"), F.col("item_id").alias("detail"), F.lit(None).cast("map<string,string>").alias("extra"), "status")
    return state.upsert_state(states, state.outcome_updates(outcomes), ["status", "error"])


def _midway(s: SparkSession, d: str) -> DataFrame:
    """Documents as items in the middle of their stages."""
    kinds = ["transcribing", "correcting", "summarizing", "downloading", "error", "summarized", "corrected", "transcript_ready", "summary_ready", "success"]
    status = F.array(*map(F.lit, kinds))[(F.col("doc_id") % len(kinds)).cast("int")]
    path = F.concat(F.lit("media/"), F.col("doc_id").cast("string"), F.lit(".m4a"))
    return _docs(s, d).select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("item_id"), status.alias("status"), path.alias("audio_path"), path.alias("transcript_md"), F.lit("e").alias("error"))


@query
def recovered_midway(s, d):
    return state.recover_state(_midway(s, d), B.present(s, d)).select("item_id", "status", "error", "changed")


@query
def publish_worklist(s, d):
    rows = _midway(s, d)
    return state.stage_worklist(rows.select("pos", "item_id"), rows, "publish").select("pos", "item_id", "status", "rank")


@query
def combined_stats(s, d):
    return reports.combined_stats(stage_stats(s, d))


@query
def catalog_files(s, d):
    item = F.struct(F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("doc_id").cast("string")).alias("bvid"), F.col("source").alias("title"), F.col("n_chars").cast("int").alias("duration"), F.struct(F.col("lang").alias("name")).alias("owner"), F.col("doc_id").alias("aid"))
    page = F.floor(F.col("doc_id") / 100)
    listed = _docs(s, d).groupBy(page.alias("page")).agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", item.alias("i")))), lambda x: x["i"]).alias("list"))
    path = shared.fresh_folder(s, "catalog")
    code = F.when(F.col("page") % 5 == 4, -1).otherwise(0)
    listed.select("page", F.to_json(F.struct(code.alias("code"), F.struct("list").alias("data"))).alias("value")).write.partitionBy("page").text(path)
    return files.read_catalog(s, path, "http://h/").select("pos", "item_id", "title", "url", "duration_s", "author", "aid")


@query
def state_files(s, d):
    states = B.current(s, d).select("item_id", "status", F.col("last_attempt"), F.when(F.col("status") == "error", "failed").alias("error"))
    full = states.select("item_id", *[(F.col(f) if f in states.columns else F.lit(None).cast("long" if f == "pubdate" else "string")).alias(f) for f in S.STATE_FIELDS])
    path = shared.fresh_folder(s, "state")
    files.write_state(full, path, "json")
    return files.read_state(s, path).select("item_id", "status", "error", "has_error")


@query
def queue_files(s, d):
    queue, _ = state.build_queue(B.catalog(s, d), B.current(s, d), 50)
    path = shared.fresh_folder(s, "queue")
    files.write_queue(rules.catalog_to_queue(queue), path)
    return files.read_queue(s, path).select("pos", "item_id", "title", "url", "duration_s", "author", "pubdate")


@query
def document_files(s, d):
    docs = _docs(s, d)
    path = shared.fresh_folder(s, "documents")
    stem = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".corrected.md"))
    stage = F.when(F.col("doc_id") % 2 == 0, "transcript").otherwise("final")
    path_of = F.when(F.col("doc_id") % 2 == 0, files.stage_path(stem, "transcript")).otherwise(files.stage_path(stem, "final"))
    files.write_documents(docs.select(F.col("doc_id").alias("item_id"), stage.alias("stage"), path_of.alias("path"), F.col("text").alias("md")), path)
    return s.read.parquet(path).select("item_id", "stage", "path", F.md5(F.col("md").cast("binary")).alias("digest"))


@query
def text_files(s, d):
    path = shared.fresh_folder(s, "texts")
    _docs(s, d).select("source", "text").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("source").text(path)
    source = lambda c: F.regexp_extract(c, "source=([^/]*)/", 1)
    read = files.read_documents(s, f"{path}/*/*").groupBy(source("path").alias("source")).agg(F.sum(F.length("md")).alias("n_chars"))
    listed = files.artifact_listing(s, path, "*.txt").groupBy(source("path").alias("source")).agg(F.sum("length").alias("n_bytes"))
    return read.join(listed, "source")


@query
def placed_texts(s, d):
    """One file for each document at its path; of those that clash the first one."""
    path = shared.fresh_folder(s, "placed")
    place = files.stage_path(F.concat(F.col("source"), F.lit("/"), (F.col("doc_id") % 97).cast("string"), F.lit(".md")), "final")
    files.write_texts(_docs(s, d).select(F.col("doc_id").alias("pos"), place.alias("path"), F.col("text").alias("md")), path)
    read = files.read_documents(s, f"{path}/*/*")
    return read.select(F.regexp_extract("path", "([^/]*/[^/]*)$", 1).alias("path"), F.md5(F.col("md").cast("binary")).alias("digest"))


@query
def state_entries(s, d):
    """States with keys of any name, written, read, updated and written again: other keys stay as they were, nulls too."""
    path = shared.fresh_folder(s, "entries")
    row = F.struct(F.lit("known").alias("status"), F.col("c_acctbal").alias("balance"), F.lit(None).cast("string").alias("note"), F.struct(F.col("c_nationkey").alias("nation")).alias("home"))
    known = B.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("item_id"), F.parse_json(F.to_json(row, {"ignoreNullFields": "false"})).alias("entry"))
    files.write_entries(known, f"{path}/before", 4)
    updates = B.log(s, d).select("item_id", "seq", F.create_map(F.lit("status"), F.col("status"), F.lit("error"), F.when(F.col("status") == "error", "failed")).alias("fields"))
    files.write_entries(files.upsert_entries(files.read_entries(s, f"{path}/before"), updates), f"{path}/after", 4)
    e = F.col("entry")
    return files.read_entries(s, f"{path}/after").select(
        "item_id", files.entry_value(e, "status").alias("status"), files.entry_value(e, "error").alias("error"), files.entry_has(e, "error").alias("has_error"),
        files.entry_has(e, "note").alias("has_note"), F.round(files.entry_value(e, "balance", "double"), 2).alias("balance"), files.entry_value(e, "home.nation", "long").alias("nation"),
    )


@query
def asked_once(s, d):
    """Every line of the conversations as a prompt: equal ones are asked once, in two runs of which the second asks nothing."""
    store = shared.fresh_folder(s, "answers")
    talk = B.speech(s, d).select("item_id", "seq", F.concat(F.lit("Say it: "), F.lower("speaker"), F.lit(" "), F.substring_index("text", ".", 1)).alias("prompt"))
    infer.infer_once(talk, _echo, store, waves=2)
    return infer.infer_once(talk, _fails, store, waves=1).select("item_id", "seq", F.md5(F.col("response").cast("binary")).alias("digest"), "error")


@query
def eval_files(s, d):
    path, results = shared.fresh_folder(s, "eval"), shared.fresh_folder(s, "results")
    docs = _docs(s, d)
    header = docs.select("lang").distinct().select("lang", F.lit("# engine: e").alias("value"))
    line = X.timestamped_line(F.col("doc_id"), F.col("doc_id") + F.lit(0.5), F.col("source"), True)
    header.unionByName(docs.select("lang", line.alias("value"))).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("lang").text(path)
    read = files.read_eval_outputs(s, f"{path}/*").withColumn("lang", F.regexp_extract("path", "lang=([^/]*)/", 1))
    found = read.groupBy("lang").agg(F.max("value").alias("engine"), F.count("text").alias("n"), F.sum(F.col("end_s") - F.col("start_s")).alias("seconds"))
    files.write_eval_results(found, results)
    return s.read.schema(found.schema).json(results)


def _streamed(s: SparkSession, d: str, name: str, updates: DataFrame, batches: int) -> DataFrame:
    """The written changes of a stream of updates in several micro-batches, which cut the order of seq."""
    path = shared.fresh_folder(s, name)
    updates.repartitionByRange(batches, F.pmod(F.xxhash64("seq"), F.lit(1009))).write.parquet(f"{path}/in")
    store, key = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(key)
    s.conf.set(key, store)
    try:
        stream = s.readStream.schema(updates.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        out = jobs.state_stream(stream).writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
        out.foreachBatch(lambda frame, number: frame.write.mode("overwrite").parquet(f"{path}/out/batch={number}")).start().awaitTermination()
    finally:
        s.conf.set(key, before)
    return s.read.parquet(f"{path}/out")


@query
def state_stream(s, d):
    """Events as a stream of updates of one field; the last change of each item counts."""
    updates = B.table(s, d, "events").select(F.col("user_id").cast("string").alias("item_id"), F.col("event_id").cast("long").alias("seq"), F.create_map(F.lit("status"), F.col("event_type")).alias("fields"))
    return jobs.last_changes(_streamed(s, d, "stream", updates, 3)).select("item_id", "seq", F.col("fields")["status"].alias("status"))


@query
def upsert_stream(s, d):
    """Events as a stream of partial updates: some name an error, some name it as null, some name nothing."""
    status = F.create_map(F.lit("status"), F.col("event_type"))
    failed = F.create_map(F.lit("status"), F.col("event_type"), F.lit("error"), F.when(F.col("event_type") == "error", F.concat(F.lit("at "), F.col("event_id").cast("string"))))
    fields = F.when(F.col("event_type").isin("error", "signup"), failed).when(F.col("event_type") == "click", F.create_map().cast("map<string,string>")).otherwise(status)
    updates = B.table(s, d, "events").select(F.col("user_id").cast("string").alias("item_id"), F.col("event_id").cast("long").alias("seq"), fields.alias("fields"))
    changes = jobs.last_changes(_streamed(s, d, "upserts", updates, 4))
    known = B.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("item_id"), F.lit("known").alias("status"), F.lit("old").alias("error"))
    return state.upsert_state(known, changes, ["status", "error"])


@query
def ingest_stream(s, d):
    """Catalog files taken in as a stream: queue and states after the last batch."""
    path = shared.fresh_folder(s, "ingest")
    item = F.struct(F.col("doc_id").cast("string").alias("bvid"), F.col("source").alias("title"), F.col("n_chars").cast("int").alias("duration"))
    listed = _docs(s, d).groupBy(F.floor(F.col("doc_id") / 1000).alias("page")).agg(F.collect_list(item).alias("list"))
    listed.select(F.to_json(F.struct(F.lit(0).alias("code"), F.struct("list").alias("data"))).alias("value")).write.option("maxRecordsPerFile", 1).text(f"{path}/in")
    _ingested(s, d, path, f"{path}/in", 1 << 40)
    queued = s.read.parquet(f"{path}/queue").select("item_id", F.lit(True).alias("queued")).distinct()
    after = s.read.parquet(f"{path}/state/{sum(1 for _ in _batches(s, path)):06d}")
    return after.join(queued, "item_id", "left").select("item_id", "status", F.col("last_seen") != "then", F.coalesce("queued", F.lit(False)).alias("queued")).toDF("item_id", "status", "seen", "queued")


def _entries(s: SparkSession, d: str) -> DataFrame:
    """The words of six letters or more of the benchmark, and where each is first."""
    words = B.table(s, d, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\p{L}{6,}"), F.lit(0))).alias("i", "entry"))
    return words.groupBy("entry").agg(F.min(F.shiftleft("item_id", 16) + F.col("i")).alias("pos"))


@query
def denied_texts(s, d):
    """Whole documents, and the names of suppliers, against a deny table: which entry is hit first."""
    return lookup.denied_by(_docs(s, d), "text", _entries(s, d)).select("doc_id", "denied_by")


@query
def denied_authors(s, d):
    deny = B.table(s, d, "supplier").select(F.concat(F.lit("C"), F.substring("s_name", 11, 20)).alias("entry"), F.col("s_suppkey").alias("pos"))
    rows = B.table(s, d, "customer").select(F.col("c_custkey").alias("item_id"), F.replace("c_name", F.lit("ustomer#"), F.lit("")).alias("author"))
    return rules.author_denied_by(rows, deny).select("item_id", "denied_by")


@query
def phrase_tables(s, d):
    """Every word of a table in whole documents, the longest that fits first, put in brackets."""
    table = {r.entry: f"<{r.entry}>" for r in _entries(s, d).toLocalIterator()}
    return _docs(s, d).select("doc_id", F.md5(lookup.replace_phrases(F.col("text"), table, {"e": "é"}).cast("binary")).alias("digest"))


def _batches(s: SparkSession, path: str) -> list[int]:
    """Ids of the batches whose queue is written."""
    return [r.batch for r in s.read.parquet(f"{path}/batches").distinct().collect()]


def _ingested(s: SparkSession, d: str, path: str, source: str, most: int) -> None:
    """One run over new files: the state before batch n is in state/n, its queue in queue/batch=n, and batches names all."""
    first = f"{path}/state/000000"
    known = B.current(s, d).select("item_id", "status", F.lit("then").alias("first_seen"), F.lit("then").alias("last_seen"), F.lit(None).cast("long").alias("pubdate"))
    known.write.mode("ignore").parquet(first)

    def save(queue: DataFrame, after: DataFrame, number: int) -> None:
        after.write.mode("overwrite").parquet(f"{path}/state/{number + 1:06d}")
        queue.select("pos", "item_id", "status").write.mode("overwrite").parquet(f"{path}/queue/batch={number}")
        s.range(number, number + 1).withColumnRenamed("id", "batch").write.mode("overwrite").parquet(f"{path}/batches/of={number}")

    load = lambda number: s.read.parquet(f"{path}/state/{number:06d}")
    jobs.incremental_ingest(s, source, f"{path}/checkpoint", "http://h/", rules.Rules(300), load, save, most).awaitTermination()


@query
def ingest_in_order(s, d):
    """Catalog files that arrive in five lots, each taken in by a run of its own: the capped queue over all, in order of arrival and path."""
    path = shared.fresh_folder(s, "lots")
    item = F.struct(F.col("doc_id").cast("string").alias("bvid"), F.col("source").alias("title"), F.col("n_chars").cast("int").alias("duration"))
    listed = _docs(s, d).groupBy(F.floor(F.col("doc_id") / 100).alias("page")).agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", item.alias("i")))), lambda x: x["i"]).alias("list"))
    listed = listed.select("page", F.to_json(F.struct(F.lit(0).alias("code"), F.struct("list").alias("data"))).alias("value"))
    for lot in range(5):
        listed.where(F.col("page") % 5 == lot).write.partitionBy("page").text(f"{path}/in/lot={lot}")
        _ingested(s, d, path, f"{path}/in/*/*", 120)
    return s.read.parquet(f"{path}/queue").select("pos", "item_id", "status")


@query
def skipped_states(s, d):
    """What the model's decisions make of the states: skipped items are named, all others stay as they were."""
    states = B.current(s, d).select("item_id", "status", *[F.lit(None).cast("string").alias(c) for c in ("title", "up_name", "last_attempt")])
    queue = B.catalog(s, d).select("pos", "item_id", F.col("url").alias("title"), "author")
    decided = rules.ai_decision_filter(queue, B.current(s, d), B.toxic(s, d).dropDuplicates(["item_id"]), 1 << 30)
    return state.upsert_state(states, state.outcome_updates(rules.skipped_outcomes(decided, F.lit("now"))), ["status", "title", "up_name", "last_attempt"])


def _echo(prompt: str) -> str:
    """A deterministic stand-in for a model: what follows the instruction."""
    return "<think>hm</think>" + prompt.split(": ", 1)[1]


def _fails(prompt: str) -> str:
    """A model that must not be asked."""
    raise ValueError(prompt)
