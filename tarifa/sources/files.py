"""Files of the session's file systems: what readers and writers of DataFrames don't do by themselves."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Moves a file within its file system; OSError if it can't be."""
    from py4j.protocol import Py4JJavaError

    fs, at = _at(spark, path)
    _, target = _at(spark, to)
    try:
        fs.mkdirs(target.getParent())
        done = fs.rename(at, target)
    except Py4JJavaError as e:
        raise OSError(str(e.java_exception)) from e
    if not done:
        raise OSError(f"{path} can't be moved to {to}")


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files of a folder, in order; none if there is no folder."""
    fs, at = _at(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(at) if f.isFile()) if fs.exists(at) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written whole."""
    fs, at = _at(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
