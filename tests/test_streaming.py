"""Streams against the batch operators."""

import glob
import os
import random
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from talkweave.operators import rules, state
from talkweave.sources import files
from talkweave.streaming import jobs


UPDATES = "item_id string, seq long, fields map<string,string>"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def run_fold(spark, folder, number, **options):
    """One run over the files that are there; its changes go to out/run=number."""
    stream = jobs.state_stream(spark.readStream.schema(UPDATES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), **options)
    writer = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True)
    writer.foreachBatch(lambda frame, batch: frame.write.mode("overwrite").parquet(f"{folder}/out/run={number}/batch={batch}")).start().awaitTermination(180)


def test_stream_of_partial_updates_equals_batch(spark, rocks, tmp_path):
    """Named fields, explicit nulls, insertion without fields and late updates, over shuffled batches and a restart."""
    rng = random.Random(4)
    fields = lambda: rng.choice([{}, {"status": rng.choice("xyz")}, {"error": None}, {"status": "e", "error": rng.choice(["p", None])}, None])
    updates = [(f"i{rng.randrange(12)}", seq, fields()) for seq in range(150)] + [("only", 1000, {}), ("none", 1001, None)]
    rng.shuffle(updates)
    known = spark.createDataFrame([("i0", "k", "old"), ("i1", "k", "old"), ("other", "k", "old")], "item_id string, status string, error string")
    want = state.upsert_state(known, spark.createDataFrame(updates, UPDATES), ["status", "error"])
    for number, part in enumerate([updates[:60], updates[60:]]):
        for k in range(0, len(part), 25):
            spark.createDataFrame(part[k : k + 25], UPDATES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run_fold(spark, tmp_path, number)
    changes = spark.read.parquet(f"{tmp_path}/out")
    got = state.upsert_state(known, jobs.last_changes(changes), ["status", "error"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def changes_until(spark, folder, query, found):
    """All changes once ``found`` holds of them; a stream with processing times doesn't end by itself."""
    for _ in range(300):
        rows = [r for path in glob.glob(f"{folder}/out/batch=*/_SUCCESS") for r in spark.read.schema(jobs.CHANGES).parquet(os.path.dirname(path)).collect()]
        if found(rows):
            return rows
        assert query.isActive
        time.sleep(0.2)
    raise AssertionError(rows)


def start_fold(spark, folder, **options):
    stream = jobs.state_stream(spark.readStream.schema(UPDATES).parquet(f"{folder}/in"), **options)
    writer = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/cp").trigger(processingTime="100 milliseconds")
    return writer.foreachBatch(lambda frame, batch: frame.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")).start()


def test_idle_items_expire(spark, rocks, tmp_path):
    """An item without updates for its time is reported and forgotten: an earlier seq counts again."""
    write = lambda seq, value: spark.createDataFrame([("a", seq, {"status": value})], UPDATES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    write(9, "x")
    query = start_fold(spark, tmp_path, idle_ms=300)
    try:
        rows = changes_until(spark, tmp_path, query, lambda rows: any(r.expired for r in rows))
        assert {(r.item_id, r.seq, r.value) for r in rows if not r.expired} == {("a", 9, "x")} and {r.item_id for r in rows if r.expired} == {"a"}
        write(2, "z")
        changes_until(spark, tmp_path, query, lambda rows: any((r.seq, r.value) == (2, "z") for r in rows))
    finally:
        query.stop()


def test_fields_with_ttl(spark, rocks, tmp_path):
    spark.createDataFrame([("a", 1, {"status": "x"}), ("a", 3, {"status": "z"}), ("a", 2, {"error": None})], UPDATES).coalesce(1).write.parquet(f"{tmp_path}/in")
    query = start_fold(spark, tmp_path, ttl_ms=3_600_000)
    try:
        rows = changes_until(spark, tmp_path, query, lambda rows: bool(rows))
    finally:
        query.stop()
    assert {(r.field, r.seq, r.value) for r in rows} == {("status", 3, "z"), ("error", 2, None)}


def test_incremental_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"code":0,"data":{"list":[{"bvid":"A","title":"t","duration":500},{"bvid":"B","title":"t","duration":5}]}}')
    empty = spark.createDataFrame([], "item_id string, status string, first_seen string, last_seen string, pubdate long")
    saved = {}

    def save(queue, new_state, number):
        saved[number] = ([r.item_id for r in queue.collect()], [(r.item_id, r.status) for r in new_state.collect()])

    jobs.incremental_ingest(spark, str(tmp_path / "in"), str(tmp_path / "cp"), "http://h/", rules.Rules(60), lambda number: empty, save).awaitTermination(120)
    assert saved == {0: (["A"], [("A", "new")])}


def write_catalog(folder, name, ids):
    folder.mkdir(exist_ok=True)
    items = ",".join(f'{{"bvid":"{i}","title":"t","duration":500}}' if i else "null" for i in ids)
    (folder / f"{name}.json").write_text(f'{{"code":0,"data":{{"list":[{items}]}}}}')


def test_positions_over_several_files(spark, tmp_path):
    """Positions go on from file to file; items that don't count keep theirs."""
    write_catalog(tmp_path / "in", "b", ["c", "", "d"])
    write_catalog(tmp_path / "in", "a", ["a", "b"])
    (tmp_path / "in" / "0.json").write_text('{"code":-1,"data":{"list":[{"bvid":"x"}]}}')
    found = files.read_catalog(spark, str(tmp_path / "in"), "http://h/")
    assert sorted((r.pos, r.item_id) for r in found.collect()) == [(0, "a"), (1, "b"), (2, "c"), (4, "d")]


def test_capped_queue_over_batches_equals_one_batch(spark, tmp_path):
    """Five files in three batches, one of them twice: the queue is that of all files at once."""
    known = spark.createDataFrame([("b0", "uploaded", "t", "t", None), ("c1", "success", "t", "t", None)], "item_id string, status string, first_seen string, last_seen string, pubdate long")
    for name in "abcde":
        write_catalog(tmp_path / "in", name, [f"{name}{k}" for k in range(4)])
        time.sleep(0.02)
    known.write.parquet(f"{tmp_path}/state/0")
    failed = []

    def save(queue, after, number):
        after.write.mode("overwrite").parquet(f"{tmp_path}/state/{number + 1}")
        queue.write.mode("overwrite").parquet(f"{tmp_path}/queue/batch={number}")
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("killed in the middle")

    def run():
        load = lambda number: spark.read.parquet(f"{tmp_path}/state/{number}")
        return jobs.incremental_ingest(spark, str(tmp_path / "in"), str(tmp_path / "cp"), "http://h/", rules.Rules(60), load, save, 12, 2)

    with pytest.raises(StreamingQueryException):
        run().awaitTermination(180)
    run().awaitTermination(180)
    got = spark.read.parquet(f"{tmp_path}/queue")
    assert {r.batch for r in got.collect()} == {0, 1}  # the third one finds the queue full
    catalog = files.read_catalog(spark, str(tmp_path / "in"), "http://h/")
    want, seen = state.build_queue(catalog, known, 12)
    assert sorted((r.pos, r.item_id, r.status) for r in got.collect()) == sorted((r.pos, r.item_id, r.status) for r in want.collect())
    after = state.mark_seen(known, seen.select("item_id", "pubdate"), F.lit("now"))
    last = spark.read.parquet(f"{tmp_path}/state/3")
    assert sorted((r.item_id, r.status) for r in last.collect()) == sorted((r.item_id, r.status) for r in after.collect())
