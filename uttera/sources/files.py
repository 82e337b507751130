"""File listings and small text files through the Hadoop file system, so that any path
Spark can read works."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession


def opened(address: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of an address that tasks can open themselves; Hadoop writes local ones with a single slash."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", address))


def tasks_can_open(address: str) -> bool:
    """Whether Python tasks have a reader for the address's file system; others are left to Spark's readers."""
    try:
        opened(address)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _fs(spark, path)
    return fs.exists(target)


def list_files(spark: SparkSession, root: str) -> list[str]:
    """All files below a folder (or the file itself), sorted; hidden ones left out."""
    target, fs = _fs(spark, root)
    if fs.getFileStatus(target).isFile():
        return [root]
    found, walk = [], fs.listFiles(target, True)
    while walk.hasNext():
        path = walk.next().getPath()
        if not path.getName().startswith(("_", ".")):
            found.append(path.toString())
    return sorted(found)


def first_line(spark: SparkSession, path: str) -> str:
    target, fs = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    stream = fs.open(target)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        return reader.readLine() or ""
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, body: str) -> None:
    """Replace a small file so that readers see the old text or the new one, never a part."""
    beside = f"{path}.{uuid.uuid4().hex}"
    write_text(spark, beside, body)
    target, fs = _fs(spark, path)
    source = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(beside)
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    option = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = option
    context.rename(fs.makeQualified(source), fs.makeQualified(target), options)


def write_text(spark: SparkSession, path: str, body: str) -> None:
    target, fs = _fs(spark, path)
    stream = fs.create(target, True)
    try:
        stream.write(bytearray(body.encode("utf-8")))
    finally:
        stream.close()
