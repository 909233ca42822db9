"""Column picking and shared storage that all operators of this subpackage use."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import threading
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH, _DEFAULT_BATCH = "16m", 1 << 26
_MMAP_THRESHOLD = -3


def _lean() -> None:
    """Arrays of a megabyte or more are mapped, so that freeing them gives them back: Python workers live on between tasks, beside the executor's heap."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(_MMAP_THRESHOLD, 1 << 20)
    except (AttributeError, OSError):  # not this C library
        pass


_lean()

DOCUMENT = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def narrow(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exactly the named columns, cast to the given types.

    A column is found by its exact name, else by its name in any case; the first
    such column counts. One that is missing becomes null. Other columns, clashing
    names among them, are dropped. Where the session has Spark's own limit for Arrow
    batches, it is lowered: texts pass through Python in batches of 16 MB.
    """
    conf, limit = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(limit, None) in (f"{_DEFAULT_BATCH}b", str(_DEFAULT_BATCH)):
        conf.set(limit, _BATCH)
    safe = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    out = []
    for name, kind in columns.items():
        at = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        out.append((F.col(f"__c{at[0]}") if at else F.lit(None)).cast(kind).alias(name))
    return safe.select(*out)


def tmp(name: str) -> str:
    return f"__uf_{name}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset a folder of this machine, if all executors are on it; else an error."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    at = f"file://{tempfile.mkdtemp(prefix='urlflow-')}"
    spark.sparkContext.setCheckpointDir(at)
    return at


_MADE = threading.local()


def made() -> list[str]:
    """What this thread has put into the shared folder, in order."""
    if not hasattr(_MADE, "paths"):
        _MADE.paths = []
    return _MADE.paths


def new_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder for what the caller leaves there; release() deletes it, or the end of this process."""
    made().append(f"{shared_dir(spark)}/urlflow-{name}-{uuid.uuid4().hex}")
    _LEFT.add(made()[-1])
    return made()[-1]


_LEFT: set[str] = set()


@atexit.register
def _clean() -> None:
    """Deletes what was made and not released: results that are still read need it until now. Where the folder can't be reached any more, it stays."""
    for path in _LEFT:
        try:
            at, base = fs.FileSystem.from_uri(path)
            at.delete_dir(base)
        except (OSError, ValueError):
            continue


def release(spark: SparkSession, since: int = 0, but: str | None = None) -> None:
    """Deletes what this thread has put into the shared folder since made() had `since` entries, but for one."""
    for path in made()[since:]:
        if path != but:
            remove(spark, path)
            _LEFT.discard(path)
    del made()[since:]
    if but is not None:
        made().append(but)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes one of the paths that new_path() gave this thread, before the others."""
    remove(spark, path)
    made().remove(path)
    _LEFT.discard(path)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    at = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def trim() -> None:
    """Gives freed memory back to the system, at the end of a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def small(df: DataFrame, most_rows: int = 1 << 20) -> DataFrame:
    """df, marked for broadcast if it has few rows; df is a staged table, so counting it is cheap. Otherwise Spark picks the join."""
    return F.broadcast(df) if df.count() <= most_rows else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(columns: dict[str, str] = DOCUMENT) -> Column:
    """Two hashes of a row; nulls are told from values of the columns beside them."""
    held = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(*[F.xxhash64(F.lit(salt), *held).alias(name) for salt, name in ((1, "a"), (2, "b"))])


def mix_column(c: Column, *salt: int) -> Column:
    return F.xxhash64(c, *[F.lit(s) for s in salt])
