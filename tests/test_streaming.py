"""The job log as a stream ends where the batch operators do."""

from pyspark.sql import functions as F

from pixelweir.queries import job_log
from pixelweir.streaming import jobs


def test_states_follow_the_log(spark, tmp_path):
    log = job_log(spark, "/root/testdata/sf0.001").withColumn("progress", F.col("progress").cast("double")).withColumn("job_id", F.col("job_id").cast("string"))
    folder = str(tmp_path / "log")
    log.repartition(1).write.parquet(folder)
    stream = jobs.read_log(spark, folder, log._jdf.schema().toDDL())
    q = jobs.job_states(stream.select("job_id", "ts", "status", "progress")).writeStream.format("memory").queryName("states").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.job_id: r for r in spark.sql("SELECT * FROM states").collect() if not r.expired}
    want = {r.job_id: r for r in log.groupBy("job_id").agg(F.max("progress").alias("progress"), F.count("*").alias("n"), F.max("ts").alias("ts")).collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        assert (got[k].progress, got[k].n_updates, got[k].updated) == (r.progress, r.n, r.ts)
        assert got[k].status in ("queued", "running", "succeeded", "failed")


def test_windows_close_behind_the_watermark(spark, tmp_path):
    log = job_log(spark, "/root/testdata/sf0.001")
    folder = str(tmp_path / "log")
    log.write.parquet(folder)
    stream = jobs.read_log(spark, folder, log._jdf.schema().toDDL())
    q = jobs.status_windows(stream, "1 day").writeStream.format("memory").queryName("windows").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.start, r.status): r.n for r in spark.sql("SELECT * FROM windows").collect()}
    want = {(r.start, r.status): r["count"] for r in log.groupBy(F.window("ts", "1 day").start.alias("start"), "status").count().collect()}
    assert got and all(want[k] == n for k, n in got.items())
