"""The keyed state table: seen marks, partial updates, queues, worklists, outcomes, recovery (C, D)."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkweave import schemas as S

#: Rows per range when positions are counted through; see ``counted_before``.
RANGE = 1 << 20


def mark_seen(state: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """Seen ids: new ones start as new, all get last_seen, pubdate changes only to a value. seen: item_id, pubdate."""
    seen = seen.groupBy("item_id").agg(F.max("pubdate").alias("seen_pubdate")).withColumn("seen", F.lit(True))
    both = state.withColumn("known", F.lit(True)).join(seen, "item_id", "full_outer")
    fresh = F.col("known").isNull()
    stamp = now.cast("string")
    both = both.withColumns({
        "first_seen": F.when(fresh, stamp).otherwise(F.col("first_seen")),
        "status": F.when(fresh, S.NEW).otherwise(F.col("status")),
        "last_seen": F.when(F.col("seen"), stamp).otherwise(F.col("last_seen")),
        "pubdate": F.coalesce("seen_pubdate", "pubdate"),
    })
    return both.select(*state.columns)


def upsert_state(state: DataFrame, updates: DataFrame, fields: list[str]) -> DataFrame:
    """Partial updates in order of seq; a field given as null becomes null, one not given stays.

    updates: item_id, seq, fields map<string,string>.
    """
    both = state.join(given_fields(updates), "item_id", "full_outer")
    return both.withColumns(_with_given(state, fields)).select(*state.columns)


def given_fields(updates: DataFrame) -> DataFrame:
    """(item_id, given map): what all updates of an item give, the last value of each field."""
    last = updates.select("item_id", "seq", F.explode("fields").alias("field", "value")).groupBy("item_id", "field").agg(F.max_by(F.struct("value"), "seq").alias("last"))
    merged = last.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.col("last.value")))).alias("given"))
    only = updates.select("item_id").distinct().join(merged, "item_id", "left")
    return only.withColumn("given", F.coalesce("given", F.create_map().cast("map<string,string>")))


def _with_given(state: DataFrame, fields: list[str]) -> dict[str, Column]:
    return {f: F.when(F.map_contains_key("given", f), F.col("given")[f].cast(state.schema[f].dataType)).otherwise(F.col(f)) for f in fields}


#: Bytes of updates that are broadcast; see ``merge_state``.
BROADCAST = 64 << 20


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("item_id"), F.lit(buckets)).cast("int")


def save_state(state: DataFrame, path: str, buckets: int) -> None:
    """The state as Parquet in folders by hash of item_id, for ``merge_state``."""
    state.withColumn("bucket", _bucket(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def merge_plan(state: DataFrame, given: DataFrame, fields: list[str], few: bool) -> DataFrame:
    """The state with given fields: known rows are joined where they are read, if the given ones are few enough to broadcast; rows of new items follow."""
    mark = F.broadcast if few else lambda x: x
    known = state.join(mark(given), "item_id", "left").withColumns(_with_given(state, fields)).select(*state.columns)
    met = state.select("item_id").join(mark(given.select("item_id")), "item_id", "left_semi")
    new = given.join(met, "item_id", "left_anti").withColumns({f: F.lit(None).cast(state.schema[f].dataType) for f in state.columns if f != "item_id"})
    return known.unionByName(new.withColumns(_with_given(state, fields)).select(*state.columns))


def merge_state(spark: SparkSession, path: str, updates: DataFrame, fields: list[str], buckets: int) -> list[int]:
    """Partial updates, as in ``upsert_state``, into a saved state: only the buckets that they name are read and written again.

    Returns these buckets. The state isn't shuffled while the updates have at most BROADCAST bytes. A bucket's new files
    replace the old ones when the job commits, so a job that fails changes nothing.
    """
    given = given_fields(updates).persist(StorageLevel.DISK_ONLY)
    try:
        size = F.octet_length("item_id") + F.octet_length(F.to_json("given")) + 64
        touched = sorted(r[0] for r in given.select(_bucket(buckets)).distinct().collect())
        few = (given.agg(F.sum(size)).first()[0] or 0) <= BROADCAST
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched)).drop("bucket")
        merged = merge_plan(old, given, fields, few).withColumn("bucket", _bucket(buckets))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        return touched
    finally:
        given.unpersist()


def fold_updates(updates: DataFrame, field: str = "status") -> DataFrame:
    """(item_id, value, seq): the last value of one field by item, from rows (item_id, seq, value)."""
    return updates.groupBy("item_id").agg(F.max_by("value", "seq").alias(field), F.max("seq").alias("seq"))


def lookup_status(ids: DataFrame, state: DataFrame) -> DataFrame:
    return ids.join(state.select("item_id", "status"), "item_id", "left").withColumn("status", F.coalesce("status", F.lit(S.NEW)))


def counted_before(frame: DataFrame, counted: Column, order: str = "pos", span: int = RANGE) -> DataFrame:
    """The frame with ``before``: how many earlier rows count.

    ``order`` is a position: whole numbers, dense or sparse.  Rows are numbered within ranges of it, the
    ranges' totals within ranges of ranges, and only the totals of these, one for ``span`` ** 2 positions, are
    summed over all earlier ones.  So no window spans the whole table, even if every range has one row.
    """
    frame = frame.withColumns({"_range": F.floor(F.col(order) / span), "_counted": counted.cast("int")})
    totals = frame.groupBy("_range").agg(F.sum("_counted").alias("_total")).withColumn("_of", F.floor(F.col("_range") / span))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = totals.groupBy("_of").agg(F.sum("_total").alias("_all")).select("_of", before(Window.orderBy("_of"), "_all").alias("_start"))
    earlier = totals.withColumn("_own", before(Window.partitionBy("_of").orderBy("_range"), "_total")).join(above, "_of").select("_range", (F.col("_start") + F.col("_own")).alias("_offset"))
    inside = F.coalesce(F.sum("_counted").over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return frame.withColumn("_inside", inside).join(earlier, "_range").withColumn("before", F.col("_offset") + F.col("_inside")).drop("_range", "_counted", "_inside", "_offset")


def capped_scan(frame: DataFrame, counted: Column, most: int) -> DataFrame:
    """Rows visited by a loop that stops once ``most`` rows counted; rows that don't count are passed on the way."""
    return counted_before(frame, counted).where(F.col("before") < most).drop("before")


def build_queue(catalog: DataFrame, state: DataFrame, most: int = 50, queueable: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(queue, seen ids): the first ``most`` (one at least) queueable rows by pos, and the rows looked at until then."""
    rows = lookup_status(catalog.where(F.coalesce("item_id", F.lit("")) != ""), state)
    fit = F.col("status").isin(queueable or S.QUEUEABLE)
    looked = counted_before(rows, fit).where(F.col("before") < max(most, 1))
    return looked.where(fit).drop("before"), looked.drop("before", "status")


def reset_unfinished(state: DataFrame, terminal: list[str] | None = None) -> DataFrame:
    """Rows outside ``terminal`` back to new without an error; ``changed`` marks those that weren't so before.

    has_error, if the table has it, says that an error was given, even as null.
    """
    given = F.col("has_error") if "has_error" in state.columns else F.col("error").isNotNull()
    ends = F.coalesce(F.col("status").isin(terminal or S.TERMINAL), F.lit(False))
    changed = ~ends & ~(F.coalesce(F.col("status") == S.NEW, F.lit(False)) & ~given)
    return state.withColumn("changed", changed).withColumns({"status": F.when(ends, F.col("status")).otherwise(S.NEW), "error": F.when(ends, F.col("error"))})


def recover_state(state: DataFrame, files: DataFrame) -> DataFrame:
    """Interrupted rows back to the last finished status. files: path of existing files."""
    there = files.select(F.col("path").alias("audio_path"), F.lit(True).alias("there")).distinct()
    rows = state.join(there, "audio_path", "left")
    status = F.when(F.col("status") == S.ERROR, F.when(F.col("there"), S.DOWNLOADED).otherwise(S.NEW))
    status = reduce(lambda c, kv: c.when(F.col("status") == kv[0], kv[1]), S.RECOVERY.items(), status).otherwise(F.col("status"))
    rows = rows.withColumns({"error": F.when(F.col("status") == S.ERROR, F.lit(None)).otherwise(F.col("error")), "new_status": status})
    rows = rows.withColumn("changed", ~F.col("new_status").eqNullSafe(F.col("status")))
    return rows.withColumn("status", F.col("new_status")).select(*state.columns, "changed")


def stage_worklist(queue: DataFrame, state: DataFrame, stage: str, files: DataFrame | None = None, path: str = "transcript_md") -> DataFrame:
    """Queue rows eligible for a stage, in its order; with files (path), those whose file exists."""
    statuses = S.STAGE_STATUSES[stage]
    rows = queue.join(state.select("item_id", "status", path), "item_id", "left").withColumn("status", F.coalesce("status", F.lit(S.NEW))).where(F.col("status").isin(statuses))
    if files is not None:
        rows = rows.join(files.select(F.col("path").alias(path)), path, "left_semi")
    rank = F.array_position(F.array(*map(F.lit, statuses)), F.col("status")) if stage == "publish" else F.lit(0)
    return rows.withColumn("rank", rank).orderBy("rank", "pos")


def counted_rows(stage: str, done: Column, eligible: Column, has_file: Column) -> Column:
    """Which visited rows a stage's cap counts."""
    return {"download": eligible, "transcribe": done | (eligible & has_file), "llm": eligible & has_file, "upload": F.lit(True), "filter": eligible}[stage]


def stage_outcome(stage: str, done: Column, has_file: Column, ok: Column, has_path: Column | None = None) -> Column:
    """The names of the outcomes of a visited row."""
    one = lambda c: F.array(c)
    none = F.array().cast("array<string>")
    if stage == "download":
        return one(F.when(done, "already_downloaded").when(ok, "downloaded").otherwise("download_failed"))
    if stage == "transcribe":
        return one(F.when(done, "already_transcribed").when(~has_file, "no_audio").when(ok, "transcribed").otherwise("error"))
    if stage == "llm":
        return F.when(~has_file, none).when(ok, F.array(F.lit("corrected"), F.lit("summarized"))).otherwise(F.when(done, F.array(F.lit("corrected"), F.lit("error"))).otherwise(F.array(F.lit("error"))))
    if stage == "filter":
        return F.when(ok.isNull(), F.array(F.lit("kept"), F.lit("error"))).when(ok, F.array(F.lit("skipped"))).otherwise(F.array(F.lit("kept")))
    if stage == "publish":
        return one(F.when(has_file & ok, "converted").otherwise("error"))
    return F.when(~(has_path if has_path is not None else F.lit(True)), none).otherwise(one(F.when(has_file & ok, "uploaded").otherwise("error")))


def prioritize_current_run(ready: DataFrame, current: DataFrame) -> DataFrame:
    """Ready rows, those of the current run first, each part by pos."""
    marked = current.select("item_id", F.lit(True).alias("current")).distinct()
    return ready.join(marked, "item_id", "left").withColumn("current", F.coalesce("current", F.lit(False))).orderBy(F.desc("current"), "pos")


def touched_set(stages: list[DataFrame], batch: DataFrame) -> DataFrame:
    """(item_id, appended): ids that the stages processed, then those of the batch that are not among them."""
    touched = reduce(DataFrame.unionByName, [s.select("item_id") for s in stages]).distinct()
    rest = batch.select("item_id").distinct().join(touched, "item_id", "left_anti")
    return touched.withColumn("appended", F.lit(False)).unionByName(rest.withColumn("appended", F.lit(True)))


def status_transition_audit(log: DataFrame, edges: list[tuple[str, str]] | None = None) -> DataFrame:
    """(previous, next, n, allowed) over a log of item_id, seq, status."""
    previous = F.lag("status").over(Window.partitionBy("item_id").orderBy("seq"))
    pairs = log.withColumn("previous", previous).where("previous IS NOT NULL").groupBy("previous", F.col("status").alias("next")).agg(F.count("*").alias("n"))
    allowed = reduce(lambda a, e: a | ((F.col("previous") == e[0]) & (F.col("next") == e[1])), S.ALLOWED_EDGES if edges is None else edges, F.lit(False))
    return pairs.withColumn("allowed", allowed)


# What each outcome of a stage sets the status and the error text to.
OUTCOMES = {
    ("download", "started"): (S.DOWNLOADING, None),
    ("download", "downloaded"): (S.DOWNLOADED, None),
    ("download", "download_failed"): (S.ERROR, "Download failed"),
    ("transcribe", "started"): (S.TRANSCRIBING, None),
    ("transcribe", "transcribed"): (S.TRANSCRIPT_READY, None),
    ("transcribe", "error"): (S.ERROR, "Transcription failed: "),
    ("llm", "correcting"): (S.CORRECTING, None),
    ("llm", "corrected"): (S.CORRECTED, None),
    ("llm", "summarizing"): (S.SUMMARIZING, None),
    ("llm", "summarized"): (S.SUMMARIZED, None),
    ("llm", "error"): (S.ERROR, "LLM step failed: "),
    ("upload", "uploaded"): (S.UPLOADED, None),
    ("filter", "skipped"): (S.SKIPPED_AI, None),
}


def outcome_updates(outcomes: DataFrame) -> DataFrame:
    """Updates for ``upsert_state`` from rows item_id, seq, stage, outcome, detail, extra map<string,string>, status (before).

    Publishing sets success only on a publishable status; a failed upload changes nothing.
    """
    key = F.concat_ws("/", "stage", "outcome")
    status, message = F.lit(None).cast("string"), F.lit(None).cast("string")
    for (stage, outcome), (to, text) in OUTCOMES.items():
        status = F.when(key == f"{stage}/{outcome}", to).otherwise(status)
        if text:
            detail = F.coalesce("detail", F.lit("")) if text.endswith(" ") else F.lit("")
            message = F.when(key == f"{stage}/{outcome}", F.concat(F.lit(text), detail)).otherwise(message)
    status = F.when((key == "publish/converted") & F.col("status").isin(S.PUBLISHABLE), S.SUCCESS).otherwise(status)
    set_ = lambda name, value: F.when(value.isNotNull(), F.create_map(F.lit(name), value)).otherwise(F.create_map().cast("map<string,string>"))
    extra = F.when(key == "upload/error", F.create_map().cast("map<string,string>")).otherwise(F.coalesce("extra", F.create_map().cast("map<string,string>")))
    return outcomes.select("item_id", "seq", F.map_concat(extra, set_("status", status), set_("error", message)).alias("fields"))


def with_artifacts(rows: DataFrame, files: DataFrame, path: str, exists: bool = True) -> DataFrame:
    """Rows whose path is (or is not) among the files."""
    return rows.join(files.select(F.col("path").alias(path)).distinct(), path, "left_semi" if exists else "left_anti")


# Extensions of media files.
MEDIA = [".m4a", ".mp3", ".wav", ".mp4", ".mkv", ".webm"]


def match_artifact(stems: DataFrame, files: DataFrame, expected: str = ".m4a") -> DataFrame:
    """(stem, path) of the file for each stem: stem + expected if it is there, else the first media file by path."""
    name = F.element_at(F.split("path", "/"), -1)
    parts = files.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.[^.]*$", 0)).alias("extension"))
    parts = parts.where(F.col("extension").isin(*MEDIA, expected))
    best = parts.join(stems.select("stem").distinct(), "stem").groupBy("stem").agg(F.min(F.struct((F.col("extension") != expected).alias("other"), "path")).alias("best"))
    return best.select("stem", F.col("best.path").alias("path"))
