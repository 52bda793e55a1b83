from pyspark.sql import functions as F

from stayframe.streaming.sessions import session_stream


def test_sessions_of_a_stream_equal_those_of_the_table(spark, data_dir, tmp_path):
    events = spark.read.parquet(f"{data_dir}/events.parquet")
    # a last event far ahead lets the watermark pass all others
    ahead = events.limit(1).withColumns({"ts": F.lit("2030-01-01").cast("timestamp_ntz"), "user_id": F.lit(-1).cast("long")})
    events.coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    ahead.write.parquet(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = session_stream(stream, "user_id", "ts", "value", gap="2 hours", late="40 days")
    run = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("user_id >= 0").collect()}
    whole = {tuple(r) for r in session_stream(events, "user_id", "ts", "value", gap="2 hours").collect()}
    assert got == whole and len(got) > 100
