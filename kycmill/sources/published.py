"""Folders that appear whole or not at all, and only once: the commit of writers that share a place."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def _local(path: str) -> str | None:
    """The path in the driver's own file system, or None where it lies in another."""
    url = urlparse(path)
    return url.path if url.scheme in ("", "file") else None


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    local = _local(folder)
    if local is not None:
        return sorted(os.listdir(local)) if os.path.isdir(local) else []
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []


def publish(spark: SparkSession, staged: str, target: str) -> bool:
    """Give a written folder its final name, in one step. False if somebody else has published there.

    The staged folder must not be empty and lie in the same file system as the target.
    """
    local, to = _local(staged), _local(target)
    if local is not None and to is not None:
        os.makedirs(os.path.dirname(to), exist_ok=True)
        try:
            os.rename(local, to)
        except OSError:
            if os.path.isdir(to):
                return False
            raise
        return True
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    source, end = fs.Path(staged), fs.Path(target)
    end.getFileSystem(conf).mkdirs(end.getParent())
    none = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    none[0] = fs.Options.Rename.NONE
    try:
        # Without the option to overwrite, a rename onto an existing folder fails.
        fs.FileContext.getFileContext(end.toUri(), conf).rename(source, end, none)
    except Exception:
        if end.getFileSystem(conf).exists(end):
            return False
        raise
    return True
