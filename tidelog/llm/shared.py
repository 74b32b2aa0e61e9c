"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Where it is unset, as
in local tests, a folder under the system's temporary directory is used.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder of this session."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    kept = spark.conf.get("tidelog.shared.dir", None)
    if not kept:
        kept = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("tidelog.shared.dir", kept)
    return kept


def path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/tidelog/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that it ran.
    """
    spark = df.sparkSession
    at = path(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``table`` wrote and that nothing reads any more."""
    for df in tables:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, file)


def replace(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """Write ``new``, which may read ``old``, and remove ``old``."""
    kept = table(new, name)
    drop(old)
    return kept


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Remove what earlier operators left in the shared folder."""
    _delete(spark, f"{folder(spark)}/tidelog")
