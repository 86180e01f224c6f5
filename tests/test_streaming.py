"""Streamed counts equal the counts of one batch."""

from pyspark.sql import functions as F

from skillgraph.streaming.counts import streaming_skill_counts


def test_streamed_counts(spark, tmp_path):
    rows = [(i * 3600, f"s{i % 3}", i % 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "timestamp long, skill_id string, correct int")
    frame.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    counts = streaming_skill_counts(stream)
    query = counts.writeStream.format("memory").queryName("skill_counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = spark.table("skill_counts").agg(F.sum("n_interactions"), F.sum("n_correct")).first()
    assert tuple(got) == (60, 30)
