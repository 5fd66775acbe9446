"""Incremental ingest and a continuous fold of state updates (P)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from talkweave.operators import rules, state
from talkweave.sources import files


def incremental_ingest(spark: SparkSession, source: str, checkpoint: str, url_prefix: str, kept: rules.Rules, load_state: Callable[[int], DataFrame], save: Callable[[DataFrame, DataFrame, int], None], most: int = 50, files_per_batch: int | None = None) -> StreamingQuery:
    """New catalog files, filtered, marked as seen and queued per micro-batch.

    load_state(batch id) gives the state before that batch, ``save`` gets (queue, state after, batch
    id).  Positions go on from batch to batch, and within one by path; ``most`` counts over all
    batches, so that the queues of all batches are that of all files at once.  What a batch starts
    from (next position, queued so far) is written under the checkpoint by the batch before, so a batch
    that is run again starts from the same and gives the same.
    """
    stream = spark.readStream.format("text").option("wholetext", "true")
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    marks = f"{checkpoint}/positions"

    def batch(frame: DataFrame, number: int) -> None:
        start, queued = spark.read.parquet(f"{marks}/{number - 1}").first() if number else (0, 0)
        rows = files.parse_catalog(frame, url_prefix).withColumn("pos", F.col("pos") + F.lit(start)).persist(StorageLevel.DISK_ONLY)
        try:
            before = load_state(number)
            catalog = rules.rule_filter(rows, kept)
            catalog = catalog if queued < most else catalog.where("false")
            queue, seen = state.build_queue(catalog, before, most - queued)
            save(queue, state.mark_seen(before, seen.select("item_id", "pubdate"), F.current_timestamp()), number)
            last = rows.agg(F.coalesce(F.max("pos") + 1, F.lit(start))).first()[0]
            ends = spark.createDataFrame([(last, queued + queue.count())], "start long, queued long")
            ends.write.mode("overwrite").parquet(f"{marks}/{number}")
        finally:
            rows.unpersist()

    envelopes = stream.load(source).select("value", F.col("_metadata.file_path").alias("path"))
    return envelopes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class FieldFold(StatefulProcessor):
    """The latest (seq, value) of every field of an item.

    An update changes the fields that it gives, to null too, unless a later one has given them
    already.  idle_ms: an item without updates for so long is reported as expired and forgotten;
    ttl_ms: a field is, after so long without a change.
    """

    def __init__(self, idle_ms: int | None = None, ttl_ms: int | None = None):
        self.idle_ms, self.ttl_ms = idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fields = handle.getMapState("fields", "field string", "seq long, value string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        latest: dict[str, tuple[int, str | None]] = {}
        for frame in rows:
            top = frame.loc[frame.groupby("field")["seq"].idxmax()]
            for field, seq, value in zip(top["field"], top["seq"].tolist(), top["value"], strict=True):
                if field not in latest or seq > latest[field][0]:
                    latest[field] = seq, None if pd.isna(value) else value
        changed = []
        for field, new in latest.items():
            if not self.fields.containsKey((field,)) or self.fields.getValue((field,))[0] < new[0]:
                self.fields.updateValue((field,), new)
                changed.append((key[0], field, *new, False))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield _changes(changed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.fields.clear()
        yield _changes([(key[0], "", None, None, True)])

    def close(self) -> None:
        pass


CHANGES = "item_id string, field string, seq long, value string, expired boolean"


def _changes(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["item_id", "field", "seq", "value", "expired"]).astype({"seq": "Int64", "expired": bool})


def state_stream(updates: DataFrame, idle_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """A stream of (item_id, field, seq, value, expired): the fields that updates changed, from a stream of updates.

    updates: item_id, seq long, fields map<string,string>, as for ``upsert_state``.  An update without
    fields makes its item known: it gives a change of the field "" (names of fields aren't empty).
    Needs the RocksDB state store.
    """
    given = F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("value")))
    none = F.array(F.struct(F.lit("").alias("field"), F.lit(None).cast("string").alias("value")))
    rows = updates.select("item_id", "seq", F.inline(F.when(F.size("fields") > 0, given).otherwise(none)))
    mode = "None" if idle_ms is None and ttl_ms is None else "ProcessingTime"
    return rows.groupBy("item_id").transformWithStateInPandas(FieldFold(idle_ms, ttl_ms), CHANGES, "Update", mode)


def last_changes(changes: DataFrame) -> DataFrame:
    """(item_id, seq, fields): one update of each item with all that the written changes of a stream say, as for ``upsert_state``."""
    last = changes.where("NOT expired").groupBy("item_id", "field").agg(F.max("seq").alias("seq"), F.max_by(F.struct("value"), "seq").alias("last"))
    pairs = F.filter(F.collect_list(F.struct("field", F.col("last.value").alias("value"))), lambda p: p["field"] != "")
    return last.groupBy("item_id").agg(F.max("seq").alias("seq"), F.map_from_entries(pairs).alias("fields"))
