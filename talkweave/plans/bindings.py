"""The given tables read as catalogs, state logs, turns and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.operators.rules import Rules

RULES = Rules(min_seconds=300, author_deny=["SRC3", " "], title_deny=["(?i)^the ", "[broken", "###"], keep_when_uncertain=True)
STATUS_OF_EVENT = {"signup": "new", "view": "downloaded", "click": "transcript_ready", "purchase": "uploaded", "error": "error"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """documents: title = first 60 characters, author = source, duration = n_chars, pos = doc_id."""
    docs = table(spark, folder, "documents")
    return docs.select(
        F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("item_id"), F.substring("text", 1, 60).alias("title"),
        F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("url"), F.col("n_chars").cast("int").alias("duration_s"),
        F.col("source").alias("author"), (F.lit(1_700_000_000) + F.col("doc_id") * 60).alias("pubdate"),
    )


def log(spark: SparkSession, folder: str) -> DataFrame:
    """events: item = user, seq = time and event id, status = by type of event."""
    status = F.create_map(*[F.lit(x) for kv in STATUS_OF_EVENT.items() for x in kv])
    events = table(spark, folder, "events")
    return events.select(F.col("user_id").cast("string").alias("item_id"), F.struct("ts", "event_id").alias("seq"), status[F.col("event_type")].alias("status"), "ts")


def current(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, status, last_attempt): the last status of each user."""
    return log(spark, folder).groupBy("item_id").agg(F.max_by("status", "seq").alias("status"), F.max("ts").cast("string").alias("last_attempt"))


def speech(spark: SparkSession, folder: str) -> DataFrame:
    """conversations: item = conversation, seq = turn, speaker = role."""
    return table(spark, folder, "conversations").select(F.col("conv_id").cast("string").alias("item_id"), F.col("turn").cast("int").alias("seq"), F.col("role").alias("speaker"), "text")


def intervals(spark: SparkSession, folder: str) -> DataFrame:
    """events: item = user, seq by time, speaker = type, from the hour of the event, value hours long."""
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 3.6e9
    return table(spark, folder, "events").select(F.col("user_id").cast("string").alias("item_id"), F.col("event_id").cast("int").alias("seq"), F.col("event_type").alias("speaker"), start.alias("start_s"), (start + F.col("value")).alias("end_s"), F.col("event_type").alias("text"))


def toxic(spark: SparkSession, folder: str) -> DataFrame:
    """labels as (item_id, response): what a model answered."""
    labels = table(spark, folder, "labels")
    return labels.select(F.col("doc_id").cast("string").alias("item_id"), F.when(F.col("toxic") == 1, " skip it").otherwise("KEEP").alias("response"))


def present(spark: SparkSession, folder: str) -> DataFrame:
    """labels as a listing of existing files."""
    return table(spark, folder, "labels").select(F.concat(F.lit("media/"), F.col("doc_id").cast("string"), F.lit(".m4a")).alias("path")).distinct()
