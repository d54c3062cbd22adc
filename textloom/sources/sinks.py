"""Sinks. A table is written into a new version folder, and then a pointer file is put in the place of the old one.

Readers look the pointer up once and read that version whole; old versions stay until `prune` is called, so that who
reads one isn't disturbed. A failed write changes nothing: the pointer still names the version before.
"""

from __future__ import annotations

from uuid import uuid4

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"


def _path(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that counts, or none."""
    fs, pointer = _path(spark, f"{path}/{POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return f"{path}/{bytes(stream.readAllBytes()).decode()}"
    finally:
        stream.close()


def replace_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write `df` as a new version of the table at `path`, and make it the current one; gives the version's folder.

    The pointer is written beside the old one and renamed over it, one step on HDFS and on local disks.
    """
    spark = df.sparkSession
    version = f"v-{uuid4().hex}"
    df.write.mode("errorifexists").format(fmt).save(f"{path}/{version}")
    fs, staged = _path(spark, f"{path}/{POINTER}.{version}")
    out = fs.create(staged, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(staged, jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"), options)
    return f"{path}/{version}"


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The current version of a table."""
    folder = current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.format(fmt).load(folder)


def prune(spark: SparkSession, path: str) -> int:
    """Delete all versions but the current one; gives their number."""
    fs, folder = _path(spark, path)
    keep, gone = current(spark, path), 0
    for s in fs.listStatus(folder) if keep else ():
        if s.isDirectory() and s.getPath().getName() != keep.rsplit("/", 1)[-1]:
            gone += bool(fs.delete(s.getPath(), True))
    return gone


def export(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Flat export as JSON lines or CSV with a header."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    replace_table(nodes, f"{path}/nodes")
    replace_table(edges, f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, f"{path}/nodes"), read_table(spark, f"{path}/edges")
