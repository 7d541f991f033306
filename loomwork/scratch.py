"""Where intermediate tables live, and how lineage is cut.

A table that is read more than once is written to the shared folder that the
cluster names in ``spark.checkpoint.dir``.  Every executor can read it again
when another executor is lost.  Only where that setting is absent and the master
is this machine (tests) a local temporary folder is used; elsewhere its absence
is an error.  What was written is deleted when the driver ends, or by ``clean``.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_WRITTEN: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="loomwork-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is deleted when the driver ends."""
    if not _WRITTEN:
        atexit.register(_clean_at_exit)
    _WRITTEN.append(f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def clean(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this driver; results that still read them must have been written."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _WRITTEN:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)
    _WRITTEN.clear()


def _clean_at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        spark = SparkSession.getActiveSession()
        if spark is not None:
            clean(spark)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back; its lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str | dict[str, DataFrame], name: str) -> DataFrame:
    """One of the Parquet tables of a data directory, or of a dictionary of tables."""
    if isinstance(sf_dir, dict):
        return sf_dir[name]
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_clashing(df: DataFrame, *names: str) -> DataFrame:
    """Without the columns an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])
