"""Tables that a query writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from asofkit.operators.prequential import input_bytes

#: Inputs of fewer bytes are not worth a table.
LEAST_BYTES = 256 << 20
#: Whether the shuffle files of a query go as it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ours: list = []


def written(df: DataFrame, least: int | None = None) -> DataFrame:
    """*df*, from *least* bytes of input on written as Parquet and read back: what it was made from is made once, and its shuffle files go before what follows writes its own.

    The folder is that of spark.checkpoint.dir. Without it only sessions within one process write, to a temporary folder. Tables go when the driver's process ends.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        base = f"{tempfile.gettempdir()}/checkpoints"
    if not base or input_bytes(df) < (LEAST_BYTES if least is None else least):
        return df
    path = f"{base.rstrip('/')}/asofkit/{uuid.uuid4().hex}"
    if not _ours:
        atexit.register(_sweep)
    _ours.append((spark, path))
    with cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def cleaned(spark: SparkSession):
    """Queries that run inside remove their shuffle files as they end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _sweep() -> None:
    for spark, path in _ours:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            return
