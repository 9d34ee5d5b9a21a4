"""The job store: micro-batches against one fold, buckets that stay, tombstones, a merge that is cut short."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chronotext.operators.job_store import JobStore

SCHEMA = "job long, ts long, no long, status string, progress double, error string"


def changes(seed, n=400):
    random.seed(seed)
    return [(random.randrange(40) if random.random() < 0.97 else None, random.randrange(50), i, random.choice([None, "queued", "running", "done"]), random.choice([None, 1.0, 50.0]), random.choice([None, None, "bad"])) for i in range(n)]


def folded(rows):
    out = {}
    for job, ts, no, *fields in sorted(rows, key=lambda r: (r[1], r[2])):
        if job is not None:
            now = out.setdefault(job, [None] * 5)
            now[:2] = [ts, no]
            for i, v in enumerate(fields):
                now[2 + i] = v if v is not None else now[2 + i]
    return {k: tuple(v) for k, v in out.items()}


def told(frame):
    return {r["job"]: tuple(r)[1:] for r in frame.collect()}


@pytest.mark.parametrize("batches", [1, 3])
def test_micro_batches_give_the_state_of_one(spark, tmp_path, batches):
    rows = changes(batches)
    store = JobStore(spark, str(tmp_path), SCHEMA, "job", ["ts", "no"], buckets=8)
    for i in range(batches):
        assert store.merge(spark.createDataFrame(rows[i::batches], SCHEMA), i)
    assert told(store.read()) == folded(rows)
    assert not store.merge(spark.createDataFrame(changes(9), SCHEMA), batches - 1)  # it has been merged
    assert told(store.read()) == folded(rows) and store.changes().count() == sum(r[0] is not None for r in rows)
    if batches > 1:
        assert told(store.read(0)) == folded(rows[0::batches])


def test_only_touched_buckets_are_written(spark, tmp_path):
    rows = changes(5)
    store = JobStore(spark, str(tmp_path), SCHEMA, "job", ["ts", "no"], buckets=8)
    store.merge(spark.createDataFrame(rows, SCHEMA), 0)
    before, _ = store._version(0)
    store.merge(spark.createDataFrame([(7, 99, 0, "done", None, None)], SCHEMA), 1)
    after, _ = store._version(1)
    assert sum(before[b] != after[b] for b in before) == 1 and set(before) == set(after)
    assert told(store.read())[7][2] == "done"
    store.merge(spark.createDataFrame([], SCHEMA), 2)
    assert store._version(2) == (after, 2)


def test_removed_jobs_stay_away_until_compaction(spark, tmp_path):
    rows = changes(6)
    store = JobStore(spark, str(tmp_path), SCHEMA, "job", ["ts", "no"], buckets=4)
    store.merge(spark.createDataFrame(rows, SCHEMA), 0)
    store.prune(F.col("job") % 2 == 0)
    store.merge(spark.createDataFrame([(2, 100, 0, "late", None, None), (3, 100, 0, "late", None, None)], SCHEMA), 1)
    want = {k: v for k, v in folded([*rows, (3, 100, 0, "late", None, None)]).items() if k % 2}
    assert told(store.read()) == want
    store.compact()
    assert told(store.read()) == want and len(store.versions()) == 1 and len(list(Path(tmp_path, "data").iterdir())) == 1
    store.merge(spark.createDataFrame([(2, 101, 0, "new", None, None)], SCHEMA), 2)
    assert told(store.read()) == want | {2: (101, 0, "new", None, None)}


def test_a_merge_that_is_cut_short_leaves_the_version_before(spark, tmp_path, monkeypatch):
    rows = changes(7)
    store = JobStore(spark, str(tmp_path), SCHEMA, "job", ["ts", "no"], buckets=4)
    assert told(store.read()) == {}
    store.merge(spark.createDataFrame(rows[:100], SCHEMA), 0)
    with monkeypatch.context() as m:
        m.setattr(JobStore, "_publish", lambda self, *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError, match="stopped"):
            store.merge(spark.createDataFrame(rows[100:], SCHEMA), 1)
    assert told(store.read()) == folded(rows[:100])
    store.merge(spark.createDataFrame(rows[100:], SCHEMA), 1)
    assert told(store.read()) == folded(rows) and store.changes().count() == sum(r[0] is not None for r in rows)


def test_a_stream_of_changes(spark, tmp_path):
    rows = changes(8)
    for i in range(3):
        spark.createDataFrame(rows[i::3], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = JobStore(spark, str(tmp_path / "store"), SCHEMA, "job", ["ts", "no"], buckets=4)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = store.follow(stream, str(tmp_path / "state"), availableNow=True)
    query.awaitTermination()
    assert told(store.read()) == folded(rows) and len(store.versions()) == 3
