"""Where lineage is cut.

A result that is read more than once, or that a loop builds on, is written as a Parquet
table to shared storage and read back. A lost executor then costs a re-read, later reads
take only the columns they need, and the optimizer knows the true size of the table.
"""

from __future__ import annotations

import itertools
import tempfile
import weakref

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..errors import CheckpointError

_numbers = itertools.count()
_local_folders: dict[str, str] = {}
_stored_at: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def work_folder(spark: SparkSession) -> str:
    """Folder of this application below the shared folder of the cluster."""
    context = spark.sparkContext
    shared = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    app = context.applicationId
    if not shared:
        if not context.master.startswith("local"):
            raise CheckpointError("set spark.checkpoint.dir to a shared folder")
        if app not in _local_folders:
            _local_folders[app] = tempfile.mkdtemp(prefix="codequarry-")
        shared = _local_folders[app]
    return f"{shared.rstrip('/')}/codequarry-{app}"


def cut(df: DataFrame) -> DataFrame:
    """Compute once, store, and continue from the stored rows."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{next(_numbers):06d}"
    df.write.mode("error").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    _stored_at[kept] = path
    return kept


def stored(df: DataFrame) -> DataFrame:
    """``df`` itself if it is what :func:`cut` returned, else cut now."""
    return df if df in _stored_at else cut(df)


def remove_folder(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def forget(*steps: DataFrame) -> None:
    """Remove stored steps whose last reader has finished; others are left alone."""
    for df in steps:
        path = _stored_at.pop(df, None)
        if path is not None:
            remove_folder(df.sparkSession, path)


def cut_counted(df: DataFrame, n: Column | None = None) -> tuple[DataFrame, int]:
    """:func:`cut`, and a count taken while the rows are written (all rows, or those where
    ``n`` holds), so that a loop can decide without another job."""
    watch = Observation()
    counted = F.count(F.lit(1)) if n is None else F.count_if(n)
    kept = cut(df.observe(watch, counted.alias("n")))
    return kept, watch.get.get("n", 0)
