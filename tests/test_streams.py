"""Streams over one file, over a folder of part files, and over several batches give the same rows."""

from pyspark.sql import functions as F

from tidewell.plans import bindings
from tidewell.streaming import queue

DIR = "/root/testdata/sf0.001"
NAMES = ("stream_watermark", "stream_tumbling", "stream_heartbeats")


def test_streams_read_folders_of_part_files(spark, tmp_path, monkeypatch):
    spark.read.parquet(f"{DIR}/events.parquet").repartitionByRange(5, "ts").write.parquet(str(tmp_path / "events.parquet"))
    whole = bindings._event_stream
    for name in NAMES:
        want = sorted(map(tuple, bindings.QUERIES[name](spark, DIR).collect()), key=str)
        assert sorted(map(tuple, bindings.QUERIES[name](spark, str(tmp_path)).collect()), key=str) == want and want
        if name != "stream_watermark":  # which drops what is late, and files come in any order
            monkeypatch.setattr(bindings, "_event_stream", lambda spark, d: whole(spark, d, per_trigger=1))
            assert sorted(map(tuple, bindings.QUERIES[name](spark, str(tmp_path)).collect()), key=str) == want
            monkeypatch.setattr(bindings, "_event_stream", whole)


def test_a_run_without_anything_new_keeps_the_state(spark, tmp_path):
    rows = spark.range(20).select((F.col("id") % 3).alias("k"), F.timestamp_seconds("id").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    seen = lambda: queue.heartbeats(queue.read_files(spark, str(tmp_path / "in"), rows.schema), "k", "ts")
    first = queue.run_complete(seen(), str(tmp_path / "out"), str(tmp_path / "mark")).collect()
    assert len(first) == 3 and sorted(queue.run_complete(seen(), str(tmp_path / "out"), str(tmp_path / "mark")).collect()) == sorted(first)
    (tmp_path / "none").mkdir()
    empty = queue.heartbeats(queue.read_files(spark, str(tmp_path / "none"), rows.schema), "k", "ts")
    assert queue.run_complete(empty, str(tmp_path / "out2"), str(tmp_path / "mark2")).count() == 0
