import random

from pyspark.sql import functions as F

from meridian.functions.moment import HOUR
from meridian.sources import files
from meridian.streaming import sessions
from tests.helpers import H0, back, got, h


def test_absorbed():
    assert sessions.absorbed([(0, 5)], [(5, 6), (8, 9), (7, 7)]) == [(0, 6), (8, 9)]


def test_merged_stream(spark, tmp_path):
    r = random.Random(1)
    rows = sorted((h(a), h(a) + int(r.uniform(0.1, 3) * HOUR), k) for k in range(3) for _ in range(30) for a in [r.uniform(0, 100)])
    schema = "key long, lo long, hi long"
    for n in range(6):  # in order of time, in six batches
        spark.createDataFrame([(k, a, b) for a, b, k in rows[n * 15 : n * 15 + 15]], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    spark.createDataFrame([(9, h(500), h(501))], schema).coalesce(1).write.parquet(f"{tmp_path}/in/7")  # moves the watermark on
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = sessions.merged_stream(stream.withColumn("ts", F.timestamp_micros("lo")), "1 hour")
    query = out.writeStream.format("memory").queryName("islands").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    seen = sorted((x["key"], x["lo"], x["hi"]) for x in spark.table("islands").collect() if x["key"] != 9)
    want = sorted((k, a, b) for k in range(3) for a, b in sessions.absorbed([], [(x, y) for x, y, z in rows if z == k]))
    assert seen == want


def test_session_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, H0), (1, H0 + HOUR // 2), (1, H0 + 5 * HOUR), (2, H0 + 50 * HOUR)], "key long, t long")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key long, t long").parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_micros("t"))
    query = sessions.sessions(stream, "ts", "key", "1 hour", "1 hour").writeStream.format("memory").queryName("sess").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["key"], back(r["lo"]), back(r["hi"]), r["n"]) for r in spark.table("sess").collect()) == [(1, 0, 1.5, 2), (1, 5, 6, 1)]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", h(0), h(1)), ("a", h(3), 1 << 62)], "key string, lo long, hi long")
    for fmt in ("parquet", "json", "orc", "csv"):
        files.write(df, f"{tmp_path}/{fmt}", fmt)
        schema = "key string, lo timestamp, hi timestamp"
        read = files.read(spark, f"{tmp_path}/{fmt}", F.col("lo"), F.col("hi"), {"key": F.col("key")}, fmt, schema)
        assert got(read) == got(df)
