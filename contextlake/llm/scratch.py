"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and
reading it again, so a lost executor costs a re-read and never a recomputation
of the whole chain.  The setting is read from the session.  Where it is unset, a
local master gets a temporary folder and any other one an error, as the executors
of a cluster share no local folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_local: dict[str, str] = {}
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def base(spark: SparkSession) -> str:
    """URI of the shared folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="contextlake-")
            atexit.register(shutil.rmtree, _local[app], True)
        found = "file://" + _local[app]
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed by ``sweep`` or at exit."""
    path = f"{base(spark)}/contextlake/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    for paths in _scopes.get():
        paths.append(path)
    return path


@contextmanager
def scope() -> Iterator[list[str]]:
    """The list of paths made inside, by this thread of control only."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield paths
    finally:
        _scopes.reset(token)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and return a DataFrame that reads what was written."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``table`` of what ``make`` returns, without the tables made on the way."""
    with scope() as paths:
        out = table(make(), name)
    sweep(paths[:-1])
    return out


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def sweep(paths: list[str] | None = None) -> None:
    """Remove paths (by default all); what reads them must be done."""
    for spark, path in list(_made):
        if paths is not None and path not in paths:
            continue
        _made.remove((spark, path))
        try:
            remove(spark, path)
        except Exception:  # a stopped session cannot reach its file system
            if path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


atexit.register(sweep)
