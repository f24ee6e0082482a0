"""Session defaults and the shared working folder."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators are planned for. AQE sizes the reducers and splits skewed
# joins; forcing the skew rewrite accepts one extra shuffle when the join feeds an aggregate.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # The JVM never compiles methods above 8000 bytes; wide row rules then run as split functions.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(
    cores: str = "8", memory: str = "8g", partitions: int = 8, shared: str | None = None
) -> SparkSession:
    """A local session for tests and the bench; on a cluster the job's own session is used.

    ``shared`` becomes ``spark.checkpoint.dir``, which Spark only takes while the session is built; without
    it, the folder that Spark's own defaults name holds.
    """
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidemark")
    builder = builder.config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config(
        "spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors.")
    return configured.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


def small_methods(spark: SparkSession) -> None:
    """Stages whose rules make a method that the JVM would never compile run as split functions from here on.

    The limit is that of :data:`DEFAULTS`; a job's own session need not have it, and interprets such a method else.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > int(DEFAULTS[name]):
        spark.conf.set(name, DEFAULTS[name])


@contextlib.contextmanager
def settings(spark: SparkSession, **given: str) -> Iterator[None]:
    """The session with some settings of its own while in here."""
    before = {name: spark.conf.get(name, None) for name in given}
    for name, value in given.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def freed_shuffles(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Shuffle files of the writes in here go when each write is done, not when the driver collects its garbage."""
    return settings(spark, **{"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows from here on.

    A batch is held whole by the JVM, outside its heap, and by the Python worker; rows that are long texts make the
    default of 10,000 a large part of an executor's memory.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def written(spark: SparkSession, path: str) -> bool:
    """Was a write to this folder completed? On any file system Spark knows."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that the job made for itself and that nobody else can name."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and go on from the files.

    Cuts the lineage: a lost executor costs the tasks that read it, not the work before. The size of
    the files is known to the planner, which broadcasts a staged side only when it is small enough.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
