from pyspark.sql import functions as F

from declarium.streaming import upsert


def test_cache_of_a_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, rows in enumerate(([("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z")])):
        spark.createDataFrame(rows, "key string, at int, v string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("key string, at int, v string").parquet(src)
        upsert.keep_cache(stream, "key", ["at"], out, str(tmp_path / "ck")).awaitTermination()
    got = {r.key: r.v for r in upsert.version(spark, out, 1).collect()}
    assert got == {"a": "z", "b": "y"}


def test_first_arrivals_schema(spark, tmp_path):
    spark.range(1).select(F.current_timestamp().alias("t"), F.lit("k").alias("k")).write.parquet(str(tmp_path / "i"))
    stream = spark.readStream.schema("t timestamp, k string").parquet(str(tmp_path / "i"))
    assert upsert.first_arrivals(stream, "t", ["k"]).isStreaming
