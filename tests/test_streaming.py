"""Keyframes of a stream against the same fold over the whole table."""

from pyspark.sql import functions as F

from tesserae.operators import windows
from tesserae.streaming import keyframes

SCHEMA = "clip_id string, frame_index int, spend double, weak boolean, brk boolean"


def test_stream_marks_what_the_batch_marks(spark, tmp_path):
    rows = [(c, k, 0.1 * ((k * 7 + len(c)) % 9), k % 11 == 5, False) for c in ("a", "bb") for k in range(60)]
    src = str(tmp_path / "in")
    for lo, hi in ((0, 20), (20, 45), (45, 60)):
        spark.createDataFrame([r for r in rows if lo <= r[1] < hi], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([("a", 3, 9.0, False, True)], SCHEMA).coalesce(1).write.mode("append").parquet(src)  # late
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = keyframes.mark(stream, 1.25).writeStream.outputMode("append").format("memory").queryName("marks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    q.stop()
    got = spark.table("marks")
    batch = windows.budget_marks(spark.createDataFrame(rows, SCHEMA), ["clip_id"], "frame_index", "spend", "weak", 1.25)
    expected = {(r.clip_id, k) for r in batch.collect() for k in r["at"]}
    assert {(r.clip_id, r.frame_index) for r in got.where("keyframe").collect()} == expected
    late = got.where("late").collect()
    assert [(r.clip_id, r.frame_index) for r in late] == [("a", 3)] and got.where("segment > 0").count() == 0
    assert got.where(~F.col("late")).count() == len(rows)
