"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_staged: dict[str, SparkSession] = {}  # tables of this process that are still there


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is taken, but only on a local master;
    on a cluster that would be one machine's own disk, so this raises instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = f"file://{tempfile.mkdtemp(prefix='quirelight-')}"
    spark.conf.set("spark.checkpoint.dir", base)
    _made.append((spark, base))
    return base


@atexit.register
def _clean() -> None:
    for path, spark in list(_staged.items()):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001, PERF203  the JVM may have ended before
            break
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have ended before
            import shutil

            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stage(df: DataFrame, name: str, done: tuple[DataFrame, ...] | list[DataFrame] = (), by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there,
    and a lost executor costs no more than rereading it.

    ``done``: tables staged before that nothing reads any more once this one is written;
    they are deleted. What is left at the end of the process goes then. ``by``: a column
    whose values get a folder each."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quirelight/{name}-{uuid.uuid4().hex}"
    _staged[path] = spark
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    release(*done)
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables; others are left alone."""
    for x in tables:
        path = getattr(x, "_staged_at", None)
        if path and _staged.pop(path, None) is not None:
            delete(x.sparkSession, path)
