"""Where jobs keep intermediate tables.

The folder comes from ``spark.checkpoint.dir``, which all executors must share.  Where that is not set, the
warehouse folder is used, which has to be shared as well; the driver's temporary folder never is.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_opened: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other job uses."""
    path = f"{shared_root(spark).rstrip('/')}/wordfold/{name}-{uuid.uuid4().hex}"
    for paths in _opened:
        paths.append(path)
    return path


def materialize(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """Write a table once and read it back (as ``schema``), so later stages neither recompute nor lose it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables of the jobs inside when it ends.

    Results are lazy: write or collect them inside.
    """
    paths: list[str] = []
    _opened.append(paths)
    try:
        yield
    finally:
        _opened.remove(paths)
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
