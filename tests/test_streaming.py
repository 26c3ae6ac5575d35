from pyspark.sql import functions as F

from scholargraph.streaming.search_log import append_stream, windowed_counts
from tests.conftest import DATA


def test_log_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    log = lambda df: df.select(F.lit("q").alias("query_text"), F.col("event_type").alias("query_type"), F.lit(2).alias("results_count"), F.col("ts").alias("created_at"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    append_stream(log(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    append_stream(log(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()  # nothing twice
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == events.count()
    a = {tuple(r) for r in windowed_counts(log(events)).collect()}
    assert a == {tuple(r) for r in windowed_counts(got).collect()} and sum(r[3] for r in a) == events.count()


def test_windows_of_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("event_type").alias("query_type"), F.lit(1).alias("results_count"), F.col("ts").alias("created_at"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()
