"""Session set-up and the shared folder that durable intermediates go to."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Settings results depend on, plus the adaptive ones the plans rely on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="costlens-package-"), "costlens")
    archive = shutil.make_archive(target, "zip", os.path.dirname(package), "costlens")
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    The setting is demanded; `local_default` gives a one-process session its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return named


def local_default(spark: SparkSession) -> SparkSession:
    """Where the setting is unset and driver and executors are one process, a new folder.

    For tests, benchmarks and the registered queries on one machine.
    """
    if not spark.conf.get("spark.checkpoint.dir", None) \
            and spark.sparkContext.master.startswith("local["):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="costlens-"))
    return spark


def _folder(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Is there anything at a path or pattern? Asked of the file system that holds it, as a
    read that fails would be logged as an error."""
    files, place = _folder(spark, path)
    found = files.globStatus(place)
    return found is not None and len(found) > 0


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no such folder."""
    files, place = _folder(spark, path)
    return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    files, place = _folder(spark, path)
    files.delete(place, True)


def publish(spark: SparkSession, staged: str, target: str) -> bool:
    """Rename a written folder to a name that must not be taken; False if it was.

    A folder is renamed at once, but one whose new name is taken may end up inside the
    other: so the rename counts only if the folder's own files are there afterwards.
    """
    files, source = _folder(spark, staged)
    _, place = _folder(spark, target)
    if files.exists(place):
        remove(spark, staged)
        return False
    own = set(names(spark, staged))
    files.mkdirs(place.getParent())
    try:
        files.rename(source, place)
    except Exception:  # noqa: BLE001  the file system refuses a taken name in its own way
        pass
    if own and own <= set(names(spark, target)):
        return True
    remove(spark, f"{target}/{source.getName()}")
    remove(spark, staged)
    return False


def checkpoints(spark: SparkSession) -> None:
    """Let iterative fits cut their lineage in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(run_path(spark, "checkpoints"))


def run_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, never reused by another run."""
    return f"{shared_dir(spark).rstrip('/')}/costlens/{label}-{uuid.uuid4().hex}"


def materialize(df, label: str):
    """Cut lineage through a written table, so a lost executor re-reads it."""
    path = run_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
