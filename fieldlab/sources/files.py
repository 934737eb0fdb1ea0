"""File-system steps on the driver, through the file system that Spark itself
reads a path from: listing one folder, renaming, removing, small text files."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder (one listing, not of its subfolders); none if it is missing."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _at(spark, old)
    if not fs.rename(p, _at(spark, new)[1]):
        raise OSError(f"cannot rename {old} to {new}")


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole or not at all."""
    beside = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    fs, p = _at(spark, beside)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    rename(spark, beside, path)


def get_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def recover(spark: SparkSession, path: str) -> None:
    """Finish a replacement that stopped between its two renames."""
    folder, name = path.rstrip("/").rsplit("/", 1)
    if not exists(spark, path):
        for old in (c for c in children(spark, folder) if c.startswith(f"{name}.old-")):
            rename(spark, f"{folder}/{old}", path)
            return


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Put the folder ``new`` in the place of ``path``; the old one goes last."""
    old = f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    if exists(spark, path):
        rename(spark, path, old)
    rename(spark, new, path)
    remove(spark, old)
