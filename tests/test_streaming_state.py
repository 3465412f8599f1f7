"""State with time, and appends that survive failures between write and commit."""

import random
import re
import time
from datetime import datetime, timedelta

import pytest

from concord import lifecycle as L
from concord.streaming import ledger, stateful

EVENT = "paper_id long, ts timestamp, seq long, to_status string, override boolean"
ROW = "k long, v string"


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_shuffled_events_give_the_batch_fold(spark, tmp_path, rocksdb):
    r = random.Random(5)
    start, rows = datetime(2026, 1, 1), []
    for paper in range(12):
        for i in range(r.randrange(1, 14)):
            rows.append((paper, start + timedelta(minutes=i), i, r.choice(L.STATUSES), r.random() < 0.3))
    want = {(x.paper_id, x.status, x.applied, x.rejected) for x in L.fold_status(spark.createDataFrame(rows, EVENT)).collect()}
    shuffled = rows[:]
    r.shuffle(shuffled)
    shuffled += shuffled[:5]  # repeated events
    folder, out = str(tmp_path / "in"), {}
    for i in range(0, len(shuffled), 30):
        spark.createDataFrame(shuffled[i : i + 30], EVENT).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([(99, start + timedelta(days=2), 0, "PARSED", True)], EVENT).coalesce(1).write.mode("append").parquet(folder)

    def keep(batch, _):
        for x in batch.collect():
            old = out.get(x.paper_id)
            assert old is None or x.applied + x.rejected > old[2] + old[3]
            out[x.paper_id] = tuple(x)

    for _ in range(2):  # the second start goes on from the checkpoint and adds nothing
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)
        folded = stateful.fold_status_in_order(stream, "1 day")
        folded.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        assert {x for x in out.values() if x[0] != 99} == want


def test_a_silent_run_is_reported_once_by_a_timer(spark, tmp_path, rocksdb):
    folder, seen = str(tmp_path / "in"), []
    spark.createDataFrame([(1,), (1,), (2,)], "run_id long").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("run_id long").parquet(folder)
    query = stateful.watch_runs(stream, 4000).writeStream.foreachBatch(lambda b, _: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and (1, "silent", 2) not in seen:
            time.sleep(0.5)
        spark.createDataFrame([(1,)], "run_id long").coalesce(1).write.mode("append").parquet(folder)
        while time.time() < end and (1, "silent", 3) not in seen:
            time.sleep(0.5)
    finally:
        query.stop()
    assert [x for x in seen if x[0] == 1] == [(1, "alive", 2), (1, "silent", 2), (1, "alive", 3), (1, "silent", 3)]
    assert [x for x in seen if x[0] == 2] == [(2, "alive", 1), (2, "silent", 1)]


def add(spark, folder, rows):
    spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, **more):
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = ledger.append_stream(stream, str(tmp_path / "log"), ["k"], ROW, str(tmp_path / "c"), n_buckets=8, **more)
    query.awaitTermination()


def test_a_batch_killed_before_its_commit_comes_again_once(spark, tmp_path):
    log = str(tmp_path / "log")
    add(spark, str(tmp_path / "in"), [(i, "a") for i in range(20)])
    run(spark, tmp_path)
    add(spark, str(tmp_path / "in"), [(i, "b") for i in range(10, 40)] + [(39, "c")])

    def kill(batch_id):
        raise RuntimeError("killed between write and commit")

    with pytest.raises(Exception, match="killed"):
        run(spark, tmp_path, before_commit=kill)
    assert ledger.read_log(spark, log, ROW).count() == 20  # what was written is not seen
    run(spark, tmp_path)
    got = sorted((x.k, x.v) for x in ledger.read_log(spark, log, ROW).collect())
    assert [k for k, _ in got] == list(range(40)) and all(v == "a" for k, v in got if k < 20)
    run(spark, tmp_path)  # nothing new
    assert ledger.read_log(spark, log, ROW).count() == 40
    assert sorted(x.batch for x in ledger.committed(spark, log).collect()) == [0, 1]


def test_a_committed_batch_that_comes_again_does_nothing(spark, tmp_path):
    log = str(tmp_path / "log")
    ledger.create(spark, log, ROW)
    batch = spark.createDataFrame([(1, "a"), (None, "n"), (1, "a")], ROW)
    assert ledger.append_batch(batch, 0, log, ["k"], ROW) and not ledger.append_batch(batch, 0, log, ["k"], ROW)
    assert ledger.read_log(spark, log, ROW).count() == 2
    assert ledger.append_batch(batch.limit(0), 1, log, ["k"], ROW) and ledger.read_log(spark, log, ROW).count() == 2


def test_only_the_buckets_of_the_batch_are_read(spark, tmp_path):
    log = str(tmp_path / "log")
    ledger.create(spark, log, ROW)
    ledger.append_batch(spark.range(200).selectExpr("id AS k", "'a' AS v"), 0, log, ["k"], ROW, n_buckets=16)
    plan = ledger.read_log(spark, log, ROW, [3])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ = 3", plan)
    alone = ledger.read_log(spark, log, ROW, [3]).collect()
    assert 0 < len(alone) < 40 and set(alone) <= set(ledger.read_log(spark, log, ROW).collect())
