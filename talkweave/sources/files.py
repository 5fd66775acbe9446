"""Readers and writers of catalogs, state files, queues, documents and evaluation outputs (A)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkweave import schemas as S


def parse_catalog(envelopes: DataFrame, url_prefix: str, column: str = "value") -> DataFrame:
    """Catalog rows with pos from rows of envelope JSON; error envelopes, malformed items and empty ids give none.

    Where the envelopes have a path, one for each, pos goes on from file to file in order of path; else it is the place in
    the envelope.  Each file is given a range of positions: the sizes of the earlier ones' lists, one number per file.
    """
    several = "path" in envelopes.columns
    lists = envelopes.select(F.col("path" if several else column).alias("_path"), F.from_json(column, S.API_ENVELOPE).alias("e")).where("e.code = 0")
    rows = lists.select("_path", F.posexplode("e.data.list").alias("pos", "i"))
    if several:
        sizes = rows.groupBy("_path").agg(F.max("pos").cast("long").alias("_last"))
        earlier = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("_path", F.coalesce(F.sum(F.col("_last") + 1).over(earlier), F.lit(0)).alias("_start"))
        rows = rows.join(starts, "_path").withColumn("pos", F.col("_start") + F.col("pos"))
    rows = rows.where("i IS NOT NULL")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.where(text("i.bvid") != "").select(
        "pos", F.col("i.bvid").alias("item_id"), text("i.title").alias("title"), F.concat(F.lit(url_prefix), F.col("i.bvid")).alias("url"),
        F.coalesce("i.duration", F.lit(0)).alias("duration_s"), text("i.owner.name").alias("author"), "i.aid", "i.cid", "i.pubdate",
    )


def read_catalog(spark: SparkSession, path: str, url_prefix: str) -> DataFrame:
    """Catalog rows of whole-file envelope JSON, in order of path."""
    return parse_catalog(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path")), url_prefix)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """State rows of map-of-maps JSON files; unreadable or without items: none. has_error tells a null error from none."""
    raw = F.from_json(F.get_json_object("value", "$.videos"), "map<string,string>")
    entries = spark.read.text(path, wholetext=True).select(F.explode(raw).alias("item_id", "j"))
    return entries.select("item_id", F.from_json("j", S.STATE_ENTRY).alias("v"), F.array_contains(F.json_object_keys("j"), "error").alias("has_error")).select("item_id", "v.*", "has_error")


#: Items of a state file; larger states make more files.
STATE_ITEMS = 50_000


def state_json(state: DataFrame, files: int = 1) -> DataFrame:
    """One row for each of ``files`` parts of the state, by hash of item_id: its map-of-maps JSON."""
    entry = F.struct("item_id", F.struct(*S.STATE_FIELDS))
    parts = state.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(files)).alias("part"))
    return parts.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("videos"))).alias("value")).select("value")


def write_state(state: DataFrame, path: str, form: str = "parquet") -> None:
    """Parquet, JSON lines ("lines"), or map-of-maps JSON files ("json") of about STATE_ITEMS items."""
    if form == "parquet":
        state.write.mode("overwrite").parquet(path)
    elif form == "lines":
        state.write.mode("overwrite").json(path)
    else:
        state_json(state, state.count() // STATE_ITEMS + 1).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """Queue rows with pos; a bad file gives none."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", S.QUEUE_ENVELOPE)["queue"]).alias("pos", "q"))
    return rows.select("pos", F.col("q.bvid").alias("item_id"), "q.title", "q.url", F.col("q.duration").alias("duration_s"), F.col("q.up_name").alias("author"), "q.pubdate")


def queue_json(queue: DataFrame, now: Column) -> DataFrame:
    """One row: the envelope with the queue in order of pos."""
    item = F.struct("pos", F.col("item_id").alias("bvid"), "title", "url", F.col("duration_s").alias("duration"), F.col("author").alias("up_name"), "pubdate")
    items = F.transform(F.sort_array(F.collect_list(item)), lambda s: s.dropFields("pos"))
    return queue.agg(F.to_json(F.struct(now.cast("string").alias("generated_at"), items.alias("queue"))).alias("value"))


def write_queue(queue: DataFrame, path: str) -> None:
    queue_json(queue, F.current_timestamp()).write.mode("overwrite").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, md) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("md"))


# File name endings by stage.
SUFFIXES = {"transcript": ".md", "corrected": ".corrected.md", "final": ".final.md"}


def stage_path(stem: Column, stage: str) -> Column:
    return F.concat(F.regexp_replace(stem, r"(\.corrected|\.final)?\.md$", ""), F.lit(SUFFIXES[stage]))


def write_documents(documents: DataFrame, path: str) -> None:
    """Rows item_id, stage, path, md, by stage."""
    documents.write.mode("overwrite").partitionBy("stage").parquet(path)


def write_texts(documents: DataFrame, path: str) -> None:
    """One UTF-8 text file for each document, at its path under ``path``. documents: pos, path, md.

    Of documents with one path the first by pos is written.  Tasks write to a staging folder; which files they
    wrote is a table, and so holds those of finished attempts only.  A second job moves these files to their
    places, and the staging folder goes.  A killed task leaves nothing at the places, and a move that is
    tried again finds its file moved.
    """
    spark = documents.sparkSession
    staging = f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex[:12]}"
    rank = F.struct("pos", F.xxhash64("md"))
    winners = documents.groupBy("path").agg(F.min_by("md", rank).alias("md"))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = f"{staging}/{uuid.uuid4().hex}"
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at)
        number = 0
        for batch in batches:
            names = []
            for md in batch["md"].to_pylist():
                names.append(f"{folder}/{number}")
                number += 1
                with store.open_output_stream(f"{at}/{names[-1].rsplit('/', 1)[1]}") as out:
                    out.write((md or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch["path"]], ["staged", "path"])

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[str] = set()
        for batch in batches:
            for staged, place in zip(batch["staged"].to_pylist(), batch["path"].to_pylist(), strict=True):
                store, source = fs.FileSystem.from_uri(staged)
                target = f"{fs.FileSystem.from_uri(path)[1]}/{place}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder)
                    made.add(folder)
                if store.get_file_info(source).type != fs.FileType.NotFound:
                    store.move(source, target)
            yield batch.select(["path"])

    table = f"{staging}/files"
    try:
        winners.select("path", "md").mapInArrow(stage, "staged string, path string").write.parquet(table)
        spark.read.schema("staged string, path string").parquet(table).mapInArrow(publish, "path string").write.format("noop").mode("overwrite").save()
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(staging)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, entry) of map-of-maps JSON files, the entry being a VARIANT with all its keys; unreadable files give none."""
    raw = F.from_json(F.get_json_object("value", "$.videos"), "map<string,variant>")
    return spark.read.text(path, wholetext=True).select(F.explode(raw).alias("item_id", "entry"))


def entry_value(entry: Column, field: str, kind: str = "string") -> Column:
    """A field of an entry; null where it is absent or null (see ``entry_has``) or of another kind."""
    return F.try_variant_get(entry, f"$.{field}", kind)


def entry_has(entry: Column, field: str) -> Column:
    """Whether an entry has the field, even as null."""
    return F.map_contains_key(entry.cast("map<string,variant>"), field)


def upsert_entries(state: DataFrame, updates: DataFrame) -> DataFrame:
    """Entries after partial updates in order of seq: given fields are set, to null too, and all other keys stay. updates: item_id, seq, fields map<string,string>."""
    last = updates.select("item_id", "seq", F.explode("fields").alias("field", "value")).groupBy("item_id", "field").agg(F.max_by(F.struct("value"), "seq").alias("last"))
    given = last.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.col("last.value")))).alias("given"))
    only = updates.select("item_id").distinct().join(given, "item_id", "left")
    both = state.join(only, "item_id", "full_outer")
    old = F.coalesce(F.col("entry").cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))
    new = F.transform_values(F.coalesce("given", F.create_map().cast("map<string,string>")), lambda _, v: F.parse_json(F.coalesce(F.to_json(F.struct(v.alias("v")), {"ignoreNullFields": "false"}), F.lit("{}"))))
    new = F.transform_values(new, lambda _, v: F.variant_get(v, "$.v", "variant"))
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return both.select("item_id", F.to_variant_object(F.map_concat(kept, new)).alias("entry"))


def write_entries(state: DataFrame, path: str, files: int = 1) -> None:
    """Map-of-maps JSON files of (item_id, entry), in ``files`` parts by hash of item_id."""
    pair = F.concat(F.regexp_extract(F.to_json(F.struct(F.col("item_id").alias("k"))), r'(?s)^\{"k":(.*)\}$', 1), F.lit(":"), F.to_json("entry"))
    parts = state.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(files)).alias("part")).agg(F.array_join(F.sort_array(F.collect_list(pair)), ",").alias("pairs"))
    parts.select(F.concat(F.lit('{"videos":{'), "pairs", F.lit("}}")).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def artifact_listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, modificationTime) of files, without their contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def parse_eval_lines(lines: DataFrame) -> DataFrame:
    """(path, key, value, start_s, end_s, text) of output lines: "# key: value" headers and "[s-e] text" segments."""
    header, segment = r"^# ([^:]+): (.*)$", r"^\[([0-9.]+)-([0-9.]+)\] (.*)$"
    one = lambda p, i: F.nullif(F.regexp_extract("value", p, i), F.lit(""))
    return lines.where(F.col("value").rlike(header) | F.col("value").rlike(segment)).select(
        "path", one(header, 1).alias("key"), one(header, 2).alias("value"), one(segment, 1).try_cast("double").alias("start_s"), one(segment, 2).try_cast("double").alias("end_s"), one(segment, 3).alias("text")
    )


def read_eval_outputs(spark: SparkSession, path: str) -> DataFrame:
    return parse_eval_lines(spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value"))


def write_eval_results(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)
