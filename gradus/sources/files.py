"""Small files beside tables, through the file system that Spark itself uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str, suffix: str = "") -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    hadoop, system = _at(spark, path)
    if not system.exists(hadoop):
        return []
    return sorted(n for n in (s.getPath().getName() for s in system.listStatus(hadoop)) if n.endswith(suffix) and n[0] not in "._")


def read_text(spark: SparkSession, path: str) -> str:
    hadoop, system = _at(spark, path)
    stream = system.open(hadoop)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """A whole file or none: written beside its place and moved there by one rename.

    Raises ``FileExistsError`` if something is there already, also if another writer was faster.
    """
    hadoop, system = _at(spark, path)
    jvm = spark._jvm
    beside = jvm.org.apache.hadoop.fs.Path(hadoop.getParent(), f".{hadoop.getName()}-{jvm.java.util.UUID.randomUUID()}")
    stream = system.create(beside, False)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.NONE  # refuses what exists
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(hadoop.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, hadoop, options)
    except Exception as error:
        system.delete(beside, False)
        if system.exists(hadoop):
            raise FileExistsError(path) from error
        raise


def delete(spark: SparkSession, path: str) -> None:
    hadoop, system = _at(spark, path)
    system.delete(hadoop, True)
