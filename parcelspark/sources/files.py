"""File system access through Hadoop, so that any store Spark reads also works here."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def matching(spark: SparkSession, pattern: str) -> list[str]:
    hadoop, fs = _fs(spark, pattern)
    return sorted(str(s.getPath().toString()) for s in (fs.globStatus(hadoop) or []))


def total_bytes(spark: SparkSession, paths: list[str]) -> int:
    found = (_fs(spark, path) for path in paths)
    return sum(fs.getFileStatus(hadoop).getLen() for hadoop, fs in found)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _fs(spark, path)
    return bool(fs.exists(hadoop))


def move(spark: SparkSession, path: str, new_path: str) -> None:
    """Rename a file; the folder it goes to is made."""
    old, fs = _fs(spark, path)
    new, _ = _fs(spark, new_path)
    fs.mkdirs(new.getParent())
    if not fs.rename(old, new):
        raise OSError(f"cannot move {path} to {new_path}")


def swap_in(spark: SparkSession, new_path: str, path: str) -> None:
    """Put a freshly written folder in the place of another; the old one goes only after the new one is there."""
    new, fs = _fs(spark, new_path)
    target, _ = _fs(spark, path)
    old, _ = _fs(spark, f"{path}._old")
    if fs.exists(old):
        fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"cannot set {path} aside")
    if not fs.rename(new, target):
        fs.rename(old, target)
        raise OSError(f"cannot move {new_path} to {path}")
    if fs.exists(old):
        fs.delete(old, True)
