"""Session settings and lineage cuts."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "wattframe") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="wattframe-checkpoint-"))
    return context.getCheckpointDir()


_owned: list[list[str]] = []

#: Spark's setting that lets the shuffle files of a query go when it has ended, not when the driver collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside the block leaves no shuffle files behind."""
    was = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if was is None else spark.conf.set(FREE_SHUFFLES, was)


def cut_lineage(df: DataFrame, partition: str | None = None, owned: bool = True) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    Unlike an eager ``checkpoint()`` the last stage runs only once, and later
    steps read just the columns they need and know the size of the table. With
    ``partition`` each value of that column gets a folder. Inside
    :func:`owned_cuts` the table is removed at the end, unless ``owned`` is false.
    The shuffles that led to the table are freed as soon as it is written.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    if _owned and owned:
        _owned[-1].append(path)
    writer = df.write.partitionBy(partition) if partition else df.write
    with freed_shuffles(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def owned_cuts(spark: SparkSession) -> Iterator[None]:
    """Remove every table that :func:`cut_lineage` writes inside the block.

    Write or collect results before the block ends: what depends on a removed
    table can't be computed after it.
    """
    _owned.append([])
    try:
        yield
    finally:
        for path in _owned.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
