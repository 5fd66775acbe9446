"""Counts, rankings and comparison reports (I, K)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkweave.functions import text as X


def status_counts(state: DataFrame) -> DataFrame:
    return state.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n")).orderBy("status")


def stage_stats(outcomes: DataFrame) -> DataFrame:
    """(stage, outcome, n) from rows stage, outcomes array."""
    return outcomes.select("stage", F.explode("outcomes").alias("outcome")).groupBy("stage", "outcome").agg(F.count("*").alias("n"))


def combined_stats(stats: DataFrame) -> DataFrame:
    """One row over all stages: processed, transcript_ready, corrected, summarized, download_failed, error."""
    total = lambda stage, *names: F.coalesce(F.sum(F.when(F.col("outcome").isin(*names) & F.col("stage").isin(*stage), F.col("n"))), F.lit(0))
    return stats.agg(
        total(["download", "transcribe"], "downloaded", "transcribed").alias("processed"),
        total(["transcribe"], "transcribed").alias("transcript_ready"),
        total(["llm"], "corrected").alias("corrected"),
        total(["llm"], "summarized").alias("summarized"),
        total(["download"], "download_failed").alias("download_failed"),
        total(["download", "transcribe", "llm", "filter"], "error").alias("error"),
    )


def run_success(queue: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """(n, n_success, ids) of the first ``most`` queue rows; ids of the successful ones in order."""
    batch = queue.orderBy("pos").limit(most).join(state.select("item_id", "status"), "item_id", "left")
    good = F.coalesce(F.col("status").isin("success", "uploaded"), F.lit(False))
    ids = F.transform(F.sort_array(F.collect_list(F.when(good, F.struct("pos", "item_id")))), lambda s: s["item_id"])
    return batch.agg(F.count("*").alias("n"), F.count_if(good).alias("n_success"), F.array_join(ids, ",").alias("ids"))


def recent_uploads(state: DataFrame, most: int = 10) -> DataFrame:
    rows = state.where("status = 'uploaded'").withColumn("title", F.coalesce("title", F.lit("Unknown Title")))
    return rows.orderBy(F.desc_nulls_last("last_attempt"), "pos").limit(most)


def file_counts(files: DataFrame) -> DataFrame:
    """(extension, n) over a listing with path."""
    return files.groupBy(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("extension")).agg(F.count("*").alias("n"))


#: Positions of segments are summed up in ranges of 2**20, then of 2**40, then all; see ``transcript_metrics``.
SHIFTS = (20, 40, 63)


def _pieces(segments: DataFrame, mark: str) -> DataFrame:
    """Segments as what their pieces between marks add up to: has a mark, first and last piece filled, filled pieces inside."""
    parts = F.transform(F.split("text", mark), lambda p: X.ustrip(p) != "")
    inside = F.filter(F.slice("_p", 2, F.greatest(F.size("_p") - 2, F.lit(0))), lambda f: f)
    rows = segments.withColumns({"_p": parts, "seq": F.col("seq").cast("long")})
    return rows.select(
        "config_name", "seq", (F.size("_p") > 1).alias("has"), F.element_at("_p", 1).alias("first"), F.element_at("_p", -1).alias("last"),
        F.size(inside).cast("long").alias("inner"), F.length("text").cast("long").alias("chars"), F.lit(1).cast("long").alias("lines"),
    )


def _joined(rows: DataFrame, shift: int) -> DataFrame:
    """Rows of one config and range added up in order; pieces at their borders are one piece."""
    keys = ["config_name", "range"]
    rows = rows.withColumn("range", F.shiftright("seq", shift))
    before = F.coalesce(F.sum(F.col("has").cast("long")).over(Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("border", before)
    # the first piece belongs to the border before the row's first mark, the last one to that after it
    sides = F.array(F.struct(F.col("border").alias("at"), F.col("first").alias("filled"), "inner", "chars", "lines", F.col("has").cast("long").alias("marks")), F.struct((F.col("border") + F.col("has").cast("long")).alias("at"), F.col("last").alias("filled"), F.lit(0).cast("long").alias("inner"), F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("marks")))
    sums = [F.sum(c).alias(c) for c in ("inner", "chars", "lines", "marks")]
    borders = rows.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*").groupBy(*keys, "at").agg(F.max("filled").alias("filled"), *sums)
    last = F.max_by("filled", "at")
    out = borders.groupBy(*keys).agg(F.min_by("filled", "at").alias("first"), last.alias("last"), F.max("at").alias("top"), F.count_if("filled").alias("all"), *sums)
    ends = F.col("first").cast("long") + F.when(F.col("top") > 0, F.col("last").cast("long")).otherwise(0)
    return out.select("config_name", F.col("range").alias("seq"), (F.col("top") > 0).alias("has"), "first", "last", (F.col("inner") + F.col("all") - ends).alias("inner"), "chars", "lines")


def transcript_metrics(segments: DataFrame, runs: DataFrame, configs: list[str] | None = None) -> DataFrame:
    """(config_name, engine, char_count, line_count, paragraph_count, duration_seconds, error) of each run.

    segments: config_name, seq (a whole number), text; runs: config_name, engine, duration_seconds,
    error.  The texts of a config count as joined by spaces, and paragraphs are the filled pieces
    between full stops.  No text is gathered: counts are added up in ranges of seq, level by
    level, so that a window spans a range's rows only.  A failed run has zeros.
    """
    if configs:
        runs = runs.where(F.col("config_name").isin(configs))
    rows, done = _pieces(segments, "。"), 0
    for shift in SHIFTS:
        rows, done = _joined(rows, shift - done), shift
    joined = rows.select("config_name", "lines", (F.col("chars") + F.col("lines") - 1).alias("chars"), (F.col("inner") + F.col("first").cast("long") + F.when(F.col("has"), F.col("last").cast("long")).otherwise(0)).alias("pieces"))
    rows = runs.join(joined, "config_name", "left")
    number = lambda c: F.when(F.col("error").isNull(), F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    return rows.select("config_name", "engine", number(F.col("chars")).alias("char_count"), number(F.col("lines")).alias("line_count"), number(F.col("pieces")).alias("paragraph_count"), F.round("duration_seconds", 1).alias("duration_seconds"), "error")


def eval_report(metrics: DataFrame) -> DataFrame:
    """(number, config_name, engine, chars, paragraphs, seconds, status) with a star on every best run."""
    best = F.coalesce(F.max(F.when(F.col("error").isNull(), F.col("char_count"))).over(Window.partitionBy(F.lit(0))), F.lit(0))
    star = F.when(F.col("error").isNull() & (F.col("char_count") == best), " ⭐").otherwise("")
    status = F.when(F.col("error").isNull(), "✅").otherwise(F.concat(F.lit("❌ "), F.substring(F.coalesce(X.filled(F.col("error")), F.lit("Error")), 1, 30)))
    return metrics.select(F.split_part("config_name", F.lit("_"), F.lit(1)).alias("number"), "config_name", "engine", F.concat(F.col("char_count").cast("string"), star).alias("chars"), F.col("paragraph_count").alias("paragraphs"), F.col("duration_seconds").alias("seconds"), status.alias("status"))


# Headings of the evaluation report.
REPORT_TITLE, REPORT_SOURCE, REPORT_TIME, REPORT_RESULTS, REPORT_DETAILS = "# ASR 转录基准测试报告", "测试视频", "测试时间", "## 结果对比", "## 详细参数"
REPORT_COLUMNS = ["#", "配置", "引擎", "字符数", "段落数", "耗时(秒)", "状态"]
REPORT_STAR = "> ⭐ = 最多字符数 (可能意味着最完整的转录)"


def report_text(metrics: DataFrame, source: str, at: Column, details: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """One row: the evaluation report as a text, its table in order of configuration.

    source, at: what was transcribed, and when; details: names of configurations with the lines that describe
    them.  The report has a line for each configuration, so its size doesn't grow with what was transcribed.
    """
    rule = "|".join(["", "---", "------", "------", "--------", "--------", "----------", "------", ""])
    head = [REPORT_TITLE, "", f"**{REPORT_SOURCE}**: {source}"], ["", REPORT_RESULTS, "", f"| {' | '.join(REPORT_COLUMNS)} |", rule]
    tail = ["", REPORT_STAR, "", REPORT_DETAILS, "", *[line for name, lines in details or [] for line in [f"### {name}", *lines, ""]]]
    cells = F.concat_ws(" | ", "number", "config_name", "engine", "chars", F.col("paragraphs").cast("string"), F.col("seconds").cast("decimal(18,1)").cast("string"), "status")
    rows = eval_report(metrics).select(F.struct("config_name", F.concat(F.lit("| "), cells, F.lit(" |")).alias("line")).alias("row"))
    table = F.transform(F.sort_array(F.collect_list("row")), lambda r: r["line"])
    lines = F.concat(F.array(*map(F.lit, head[0]), F.concat(F.lit(f"**{REPORT_TIME}**: "), at)), F.array(*map(F.lit, head[1])), table, F.array(*map(F.lit, tail)))
    return rows.agg(F.array_join(lines, "\n").alias("text"))


def queue_preview(queue: DataFrame, most: int = 10, width: int = 60) -> DataFrame:
    """(number, title): the first titles, cut, and a last row with how many more there are."""
    head = queue.orderBy("pos").limit(most).withColumn("number", F.row_number().over(Window.orderBy("pos"))).select("number", F.substring("title", 1, width).alias("title"))
    rest = queue.agg(F.count("*").alias("n")).where(F.col("n") > most)
    return head.unionByName(rest.select(F.lit(most + 1).alias("number"), F.concat(F.lit("and "), (F.col("n") - most).cast("string"), F.lit(" more")).alias("title")))
