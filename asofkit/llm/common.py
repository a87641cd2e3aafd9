"""What the corpus operators share: column hygiene, the shared work folder, sizes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ours: list[tuple[SparkSession, str]] = []
#: Paths written by the operators that are running, the innermost last.
_running: list[list[str]] = []


def columns_ci(df: DataFrame) -> set[str]:
    return {c.lower() for c in df.columns}


def fresh(df: DataFrame, base: str) -> str:
    """A column name like *base* that no column of *df* has, whatever its case."""
    have, name = columns_ci(df), base
    while name.lower() in have:
        name = f"_{name}"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """*df* without the columns an operator is about to add, so that outputs win name clashes."""
    gone = {n.lower() for n in names}
    return df.select(*[df[c] for c in df.columns if c.lower() not in gone])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which spark.checkpoint.dir names.

    Where it is unset, a session within one process (local[...]) takes the temporary folder; others raise, for executors might not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/checkpoints"
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/asofkit/{uuid.uuid4().hex}/{name}"
    if not _ours:
        atexit.register(_sweep)
    _ours.append((spark, path))
    if _running:
        _running[-1].append(path)
    return path


def tidy(f):
    """*f*, an operator, followed by the removal of what it wrote and its result doesn't read."""

    @wraps(f)
    def run(*args, **kwargs):
        _running.append(written := [])
        try:
            out = f(*args, **kwargs)
        finally:
            _running.pop()
        files = out.inputFiles() if written else []
        read = {p for p in written if any(f"/{_folder(p)}/" in x for x in files)}
        for path in written:
            if path in read:
                if _running:
                    _running[-1].append(path)
            else:
                remove(out.sparkSession, path.rsplit("/", 1)[0])
                _ours.remove((out.sparkSession, path))
        return out

    return run


def _folder(path: str) -> str:
    """The last two names of a work path, which tell it apart."""
    return "/".join(path.rsplit("/", 2)[1:])


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration() if spark._jsc else jvm.org.apache.hadoop.conf.Configuration()
    p.getFileSystem(conf).delete(p, True)


def _sweep() -> None:
    for spark, path in _ours:
        try:
            remove(spark, path.rsplit("/", 1)[0])
        except Exception:  # noqa: BLE001  the session may have ended before
            return


#: Whether the shuffle files of a query go as it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """*df* written to the shared folder as Parquet and read back: lineage ends there and lost executors cost nothing. Its shuffle files go at once."""
    spark = df.sparkSession
    path = work_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that go to a Python worker at once: texts may be very long.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on batches for Python workers are bounded by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Gives memory that a worker has freed back to the system; idle workers share the executor with others."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def releasing(f):
    """*f*, a function over batches, followed by release()."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


def small(df: DataFrame, rows: int) -> bool:
    """Whether *df* has at most *rows* rows; looks at no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_type(df: DataFrame, name: str, kind: T.DataType | str) -> DataFrame:
    return df.withColumn(name, F.col(name).cast(kind))
