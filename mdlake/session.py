"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}  # the fallback folder of a local application


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("mdlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster that
    folder would exist on one machine and be lost with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-mdlake-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


@contextlib.contextmanager
def session_setting(spark: SparkSession, name: str, value: str):
    """The setting ``name`` has ``value`` inside, and what it had before afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stored(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Readers of the result scan narrow columns of a Parquet table instead of
    parsing the corpus again, and a lost executor costs a re-read, not a re-run.
    Shuffle files of the write go as soon as it has ended, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/mdlake/{name}-{uuid.uuid4().hex}"
    with session_setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        writer = df.write
        (writer.partitionBy(partition) if partition else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
