"""Session factory and the shared-folder helpers that cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lodestrata", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine is tested under (UTC, AQE on)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("LODESTRATA_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: spark.checkpoint.dir; in local mode (tests) a temporary one where that is unset.

    Raises ``ValueError`` on a cluster without it: a folder of the driver's machine would lose what executors write.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lodestrata-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


#: Whether Spark removes a query's shuffle files when it ends, not when the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[str] = []


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back.

    The result has no lineage, survives the loss of executors, can be scanned
    several times at the cost of reading only the columns used, and is removed
    by ``release`` or when the driver exits. Shuffle files of the write go as soon
    as it is done, so a job of several steps needs the disk of its largest one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release, spark)
    _written.append(path)
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREED, before) if before is not None else spark.conf.unset(FREED)
    return spark.read.schema(df.schema).parquet(path)


_kept: dict[tuple, object] = {}


def once(spark: SparkSession, key: tuple, build):
    """What ``build()`` gives, built once for this session and key until ``release``; for written tables that many queries read."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]


def release(spark: SparkSession) -> None:
    """Remove what ``materialize`` wrote. For long sessions, once the results built on it are written or collected."""
    _kept.clear()
    while _written:
        _drop(spark, _written.pop())


def _drop(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session is already gone; the folder is temporary anyway
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
