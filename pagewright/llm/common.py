"""Shared plumbing of the training-data operators: inputs, scratch tables, names."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and every executor can read and write.

    It is the one named by ``spark.checkpoint.dir``. Only where that is unset, as in
    local tests, a temporary folder is made and set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pagewright-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in this application's own part of the shared folder, which goes when it ends."""
    own = f"{shared_dir(spark)}/pagewright-{spark.sparkContext.applicationId}"
    if own not in _scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _scratch.add(own)
    return f"{own}/{label}-{uuid.uuid4().hex}"


_scratch: set[str] = set()


def remove(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at a file that
    survives the loss of any executor."""
    path = path or scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, so that extra input columns
    never clash with an operator's working columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        n = f"__{name}"
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def q(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add."""
    drop = {n.lower() for n in names}
    return df.select(*[q(c) for c in df.columns if c.lower() not in drop])


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def give_back() -> None:
    """Called by an operator in a Python worker at the end of a batch: memory that it freed goes back to the
    system, so that workers which wait for their next task hold little besides their tables."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


_active: list = [None, None]


def take_turn(owner: str, clear: Callable[[], None]) -> None:
    """Called by an operator in a Python worker before it fills tables of its own. Workers serve one
    operator after another; what the last one left is emptied, so that tables never add up."""
    if _active[0] not in (None, owner):
        _active[1]()
        give_back()
    _active[:] = [owner, clear]
