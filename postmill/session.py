"""Session settings the jobs rely on, and the shared folder they may write to."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)

#: Settings that change results or plans.  They are safe on a cluster: nothing
#: here names a host, a core count or a path.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Long rule chains produce long generated methods.  Above this size the JVM
    # no longer compiles them, so let Spark use split expressions instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the settings above to a session builder."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def local_session(cores: int | str = "*", app: str = "postmill", **conf: str) -> SparkSession:
    """A session on one machine, for tests and the benchmark."""
    builder = configure(SparkSession.builder.appName(app).master(f"local[{cores}]"))
    builder = builder.config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes and rows of one exchange with a Python worker.  A worker keeps a batch several times over (as
#: Arrow, as strings, lower-cased), and there is one worker per function and task.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds, whatever the texts; a session that asks for less keeps that."""
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, most)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables that all executors see.

    It is the session's ``spark.checkpoint.dir``, else the checkpoint folder of
    the context.  A local-mode session that has neither (tests, benchmark) gets
    one under Spark's warehouse folder; on a cluster the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/work"
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_folder(spark: SparkSession) -> str:
    """Folder of this application below the shared folder; ``remove_work`` deletes it."""
    return f"{shared_folder(spark).rstrip('/')}/postmill-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, by: str | None = None, compression: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the work folder, in a folder for each value of ``by``, and read again.

    Cuts lineage and gives one evaluation to plans that read the rows several
    times; unlike a local checkpoint it outlives a lost executor.
    """
    spark = df.sparkSession
    path = f"{_scratch.get() or work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def remove_work(spark: SparkSession) -> None:
    """Delete what this application wrote with ``written``; call it after the results are stored."""
    remove(spark, work_folder(spark))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables ``written`` in this block are deleted at its end: store its result, by other means, within it."""
    folder = f"{work_folder(spark)}/scratch-{uuid.uuid4().hex}"
    token = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(token)
        remove(spark, folder)
