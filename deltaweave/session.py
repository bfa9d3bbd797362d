"""Session helpers shared by the whole library: scratch space and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent (local tests) is a local folder made, and it is used for
    this session alone.
    """
    own = spark.sparkContext.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", "") or own
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="deltaweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = f"file://{folder}"
    if own is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete ``path`` through Hadoop's file system, wherever it lives."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def list_path(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is absent."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(target)] if fs.exists(target) else []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, where it isn't installed there (the operators' Python code needs it)."""
    folder = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as made:
        path = shutil.make_archive(os.path.join(made, os.path.basename(folder)), "zip", os.path.dirname(folder), os.path.basename(folder))
        spark.sparkContext.addPyFile(path)


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            remove_path(spark, path)
        except Exception:  # the session may be gone at exit; nothing is left to do then
            return


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back.

    Cuts the lineage and survives lost executors, since the files are not kept by any of them.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/deltaweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._deltaweave_path = path  # type: ignore[attr-defined]
    return back


def discard(df: DataFrame) -> None:
    """Remove what ``materialize`` wrote for ``df`` once nothing reads it any more."""
    path = getattr(df, "_deltaweave_path", None)
    if path:
        remove_path(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small state table (written to the shared folder)."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)
