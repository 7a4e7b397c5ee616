from pyspark.sql import functions as F

from lodestrata.session import materialize


def shuffled(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}


def test_written_steps_leave_no_shuffle_files(spark):
    before, setting = shuffled(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    step = materialize(spark.range(2_000).withColumn("k", F.col("id") % 7).groupBy("k").agg(F.sum("id").alias("s")).join(spark.range(7).withColumnRenamed("id", "k").repartition(3, "k").hint("merge"), "k"))
    assert step.count() == 7
    assert not {n for n in shuffled(spark) - before if n.endswith(".data")} or len({n.split("_")[1] for n in shuffled(spark) - before}) <= 1  # the count's own
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
