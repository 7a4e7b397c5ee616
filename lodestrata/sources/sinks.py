"""Sinks: versioned tables with a pointer, upserts, result packages, outbox."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, root: str, version: str, partition_by: str | None = None) -> bool:
    """Write a version once and make it the current one; False, and nothing done, if it exists.

    The pointer is written last, so readers see the old version or the new one whole.
    """
    spark = df.sparkSession
    fs, done = _fs(spark, f"{root}/version={version}/_SUCCESS")
    if fs.exists(done):
        return False
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{root}/version={version}")
    fs, pointer = _fs(spark, f"{root}/CURRENT")
    out = fs.create(pointer, True)
    out.writeBytes(version)
    out.close()
    return True


def current(spark: SparkSession, root: str) -> DataFrame:
    """The published version that the pointer names."""
    version = spark.read.text(f"{root}/CURRENT").first()[0]
    return spark.read.parquet(f"{root}/version={version}")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], replace: bool = True) -> DataFrame:
    """Old rows with new ones by key: new rows win, or with ``replace`` off only missing keys are added."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new) if replace else old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def package_statistics(chunks: DataFrame) -> DataFrame:
    """(revision, total, text, image, table, page): chunk counts of each package; unknown types count as text."""
    kind = F.when(F.col("chunk_type").isin("image", "table", "page"), F.col("chunk_type")).otherwise("text")
    return chunks.groupBy("revision").agg(F.count(F.lit(1)).alias("total"), *[F.count(F.when(kind == k, 1)).alias(k) for k in ("text", "image", "table", "page")])


def navigation(chunks: DataFrame) -> DataFrame:
    """(revision, path, own_chunks, total_chunks, depth, summary) of every section of a package and those above it.

    chunks (revision, path, chunk_type, n_pages, summary, sort_order); page chunks count their
    pages, tables and images only where a revision has nothing else; the first summary that isn't blank is taken.
    """
    from lodestrata.functions import text

    body = chunks.withColumn("is_body", F.col("chunk_type").isin("text", "page"))
    any_body = body.groupBy("revision").agg(F.max("is_body").alias("any_body"))
    used = body.join(any_body, "revision").where("is_body or not any_body").withColumn("n", F.when(F.col("chunk_type") == "page", F.greatest(F.coalesce("n_pages", F.lit(1)), F.lit(1))).otherwise(1))
    up = used.withColumn("node", F.explode(text.path_prefixes(F.col("path"))))
    own = F.col("node") == F.col("path")
    first = F.min(F.when(own & (F.trim("summary") != ""), F.struct("sort_order", "summary")))
    return up.groupBy("revision", F.col("node").alias("path")).agg(F.sum(F.when(own, F.col("n")).otherwise(0)).alias("own_chunks"), F.sum("n").alias("total_chunks"), first.alias("s")).select(
        "revision", "path", "own_chunks", "total_chunks", F.size(F.split("path", text.SEPARATOR)).alias("depth"), F.col("s.summary").alias("summary")
    )


def verified_write(df: DataFrame, path: str) -> int:
    """Write and count what can be read back; an error if a row is missing."""
    df.write.mode("overwrite").parquet(path)
    n, seen = df.count(), df.sparkSession.read.parquet(path).count()
    if n != seen:
        raise RuntimeError(f"{seen} of {n} rows can be read back")
    return seen
