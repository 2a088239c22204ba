"""Loaders of the parquet tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of the folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, path: str):
    """(path, file system) of Hadoop."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _files(spark, path)
    return fs.exists(p)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Renames a folder; if another writer was first, its folder stays and this one goes."""
    p, fs = _files(spark, path)
    if fs.exists(_files(spark, to)[0]) or not fs.rename(p, _files(spark, to)[0]):
        fs.delete(p, True)


def state(spark: SparkSession, path: str) -> str:
    """A name of the present state of a file or folder: of the names, lengths and times of all its files."""
    p, fs = _files(spark, path)
    files, found = fs.listFiles(fs.resolvePath(p), True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()[:32]
