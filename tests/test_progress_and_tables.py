"""Progress counted in passing, and recognisers as table functions."""

import time

import pytest
from pyspark.sql import functions as F

from chronotext.functions import tables
from chronotext.sources import media
from chronotext.streaming import progress


def test_stages_of_a_batch(spark):
    board = progress.Board()
    rows = board.watch(spark.range(50).repartition(3), "j", "decode", 50, failed=F.col("id") % 10 == 0)
    kept = board.watch(rows.where("id % 2 = 0"), "j", "hear", 100)
    assert board.rows() == [("j", "decode", 0, 50, 0), ("j", "hear", 0, 100, 0)] and board.percent("none") is None
    kept.write.format("noop").mode("overwrite").save()
    assert board.rows() == [("j", "decode", 50, 50, 5), ("j", "hear", 25, 100, 0)]
    assert board.percent("j") == 50.0
    assert [tuple(r) for r in board.table(spark).orderBy("stage").collect()] == board.rows()


def test_a_stream_reports_with_each_micro_batch(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    board = progress.Board()
    spark.streams.addListener(board)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = board.watch(stream, "live", "frames", 60).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
        for _ in range(50):
            if board.rows()[0][2] == 30:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(board)
    assert board.rows() == [("live", "frames", 30, 60, 0)] and board.percent("live") == 50.0


def hearing():
    def load():
        def hear(x, rate):
            if len(x) > 3:
                raise ValueError("too long")
            return [(f"v{v:g}", i * 1000 / rate, (i + 1) * 1000 / rate) for i, v in enumerate(x)]

        return tables.one_by_one(hear)

    return load


@pytest.mark.parametrize("partition", ["", "PARTITION BY m"])
def test_table_function_is_the_data_frame_form(spark, partition):
    audio = spark.createDataFrame([("a", [1.0, 2.0], 10), ("b", [], 10), ("c", [1.0] * 4, 10), ("d", [5.0], 20)], "m string, samples array<float>, rate int")
    audio.createOrReplaceTempView("some_audio")
    tables.register_recogniser(spark, "hear_some", hearing(), "m", most=2)
    got = spark.sql(f"SELECT * FROM hear_some(TABLE(some_audio) {partition})")
    assert got.columns == ["m", "seg_no", "text", "start_ms", "end_ms", "error"]

    load = hearing()

    def one(x, rate, language):
        told = load()([x], [rate])[0]
        if isinstance(told, Exception):
            raise told
        return told

    want = media.transcribe(audio, ["m"], one)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key) and got.count() == 4


def test_table_function_over_missing_samples_and_wrong_tables(spark):
    spark.createDataFrame([("a", None, 10), ("b", [1.0], None)], "m string, samples array<float>, rate int").createOrReplaceTempView("no_audio")
    tables.register_recogniser(spark, "hear_none", hearing(), "m")
    assert [(r["m"], r["error"]) for r in spark.sql("SELECT * FROM hear_none(TABLE(no_audio)) ORDER BY m").collect()] == [("a", "no samples"), ("b", "no samples")]
    with pytest.raises(Exception, match="needs a column"):
        spark.sql("SELECT * FROM hear_none(TABLE(SELECT 1 AS m))").collect()
