"""Overwriting a result folder without losing it: write beside it, then swap.

A result is written to a hidden folder next to its own; when it is complete, the
old result is renamed aside, the new one renamed into place and the old one
deleted, all through the Hadoop file system. A job killed while writing leaves
the old result as it was; one killed between the renames leaves it aside, and
:func:`recover` (called by every read and write of the folder here) puts it
back. On a store without an atomic rename the swap is a copy, with the same
steps.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    p = hadoop(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _beside(path: str, role: str) -> str:
    parent, name = posixpath.split(path.rstrip("/"))
    return posixpath.join(parent, f".{name}.{role}")


def recover(spark: SparkSession, path: str) -> bool:
    """Put a result back that a killed swap left aside; whether there was one."""
    fs, hadoop = _fs(spark, path)
    target, aside = hadoop(path), hadoop(_beside(path, "old"))
    if not fs.exists(aside):
        return False
    if fs.exists(target):                 # the swap was complete but for this deletion
        fs.delete(aside, True)
        return False
    return bool(fs.rename(aside, target))


def swap_in(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """``write(folder)`` a complete new result, then put it at ``path``."""
    recover(spark, path)
    fs, hadoop = _fs(spark, path)
    target, aside = hadoop(path), hadoop(_beside(path, "old"))
    staging = _beside(path, f"new-{uuid.uuid4().hex[:12]}")
    try:
        write(staging)
        if fs.exists(target) and not fs.rename(target, aside):
            raise OSError(f"{path} can't be renamed")
        if not fs.rename(hadoop(staging), target):
            fs.rename(aside, target)
            raise OSError(f"{staging} can't be renamed to {path}")
    except BaseException:
        fs.delete(hadoop(staging), True)
        raise
    fs.delete(aside, True)
    return path
