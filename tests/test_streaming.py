import datetime

from pyspark.sql import functions as F

from lodestrata.streaming import windows

T0 = datetime.datetime(2025, 1, 1)


def source(spark, path):
    rows = [(f"u{k % 3}", T0 + datetime.timedelta(seconds=7 * k), k // 2) for k in range(60)]
    spark.createDataFrame(rows, "user string, ts timestamp, claim bigint").repartition(2).write.parquet(path)
    return spark.read.parquet(path), spark.readStream.schema("user string, ts timestamp, claim bigint").option("maxFilesPerTrigger", 1).parquet(path)


def test_streams_equal_batches(spark, tmp_path):
    batch, stream = source(spark, str(tmp_path / "in"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    got = windows.run_available(windows.hit_counters(stream, ["user"]), "hits", "complete", str(tmp_path / "c1"))
    assert set(got.collect()) == set(windows.hit_counters(batch, ["user"]).collect())
    got = windows.run_available(windows.windowed_counts(stream, ["user"], "1 minute", late="1 day"), "wins", "update", str(tmp_path / "c2"))
    latest = got.groupBy("window_start", "user").agg(F.max("n").alias("n"))
    assert set(latest.collect()) == set(windows.windowed_counts(batch, ["user"], "1 minute").collect())
    got = windows.run_available(windows.deduplicated(stream, ["claim"], "1 day"), "once", "append", str(tmp_path / "c3"))
    assert got.count() == 30 == got.select("claim").distinct().count()


def test_limiter(spark, tmp_path):
    batch, stream = source(spark, str(tmp_path / "in"))
    got = windows.run_available(windows.limited(batch.sparkSession.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), "user", 2), "lim", "append", str(tmp_path / "c")).collect()
    want = {}
    for user in ("u0", "u1", "u2"):
        recent = []
        for t in sorted(r.ts for r in batch.collect() if r.user == user):
            recent = [x for x in recent if (t - x).total_seconds() < 60]
            ok = len(recent) < 2
            want[user, t] = ok
            if ok:
                recent.append(t)
    assert {(r.key, r.ts): r.allowed for r in got} == want
    assert all(r.retry_after_s > 0 for r in got if not r.allowed)
