"""What every query needs from a Spark session: importable workers and a shared folder."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Bytes in an Arrow batch, where the session doesn't say otherwise: whole texts may be long, and workers' memory is small.
BATCH_KEY, DEFAULT_BATCH, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def _hand_back() -> None:
    """Freed memory that the C library and Arrow hold, back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, and keep their batches small.

    On a cluster the package is shipped with --py-files or installed on the
    nodes, and the path is then merely unused. What earlier queries freed in this
    process is handed back to the system.
    """
    _hand_back()
    if spark.conf.get(BATCH_KEY) == DEFAULT_BATCH:
        spark.conf.set(BATCH_KEY, BATCH)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where it is unset on a single machine, as in tests, a folder of our own
    is made and named in the context; on a cluster each machine would have its own.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quire-shared-")
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/quire/{name}-{uuid.uuid4().hex}"


_FOLDERS: ContextVar[list[str] | None] = ContextVar("folders", default=None)


@contextmanager
def staged_folders() -> Iterator[list[str]]:
    """The folders that are staged inside, for `remove`."""
    folders: list[str] = []
    token = _FOLDERS.set(folders)
    try:
        yield folders
    finally:
        _FOLDERS.reset(token)


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders wherever Spark reaches them."""
    sc = spark.sparkContext
    for folder in folders:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    folders = _FOLDERS.get()
    if folders is not None:
        folders.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores as keep it apart from df's columns in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken or f"{name}_".lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
