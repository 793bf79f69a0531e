"""Small files of the shared folder, by the file system that the cluster has for it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _system(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there. Hidden ones are left out."""
    at, fs = _system(spark, folder)
    found = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(x for x in found if not x.startswith((".", "_")))


def write_json(spark: SparkSession, path: str, value: dict, overwrite: bool = True) -> bool:
    """Writes a file as a whole or not at all; without ``overwrite``, only if there is none. Returns whether it was written."""
    at, fs = _system(spark, path)
    if not overwrite and fs.exists(at):
        return False
    part = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    try:
        out.write(bytearray(f"{json.dumps(value)}\n".encode()))
    finally:
        out.close()
    where = [at.toUri()] if at.toUri().getScheme() else []
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(*where, spark._jsc.hadoopConfiguration())
    kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE if overwrite else kind.NONE
    try:
        context.rename(part, at, options)
    except Exception as e:
        fs.delete(part, False)
        if not overwrite and fs.exists(at):  # another writer was first
            return False
        raise e
    return True


def read_json(spark: SparkSession, path: str) -> dict:
    at, fs = _system(spark, path)
    stream = fs.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
