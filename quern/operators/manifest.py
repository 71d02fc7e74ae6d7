"""Numbered pointers to immutable data: of two writers one takes a number, the other tries again on what it finds.

A pointer is a file that is created only if it isn't there yet (the store has to be able to: HDFS and local disks are), and
holds one line of JSON. A pointer without its line's end is still being written and doesn't count.
"""
from __future__ import annotations

import json
import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str) -> dict | None:
    where, fs = _fs(spark, path)
    stream = fs.open(where)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text) if text.endswith("\n") else None


def newest(spark: SparkSession, root: str) -> tuple[int, dict | None]:
    """The highest whole pointer and its content, (0, None) without any."""
    where, fs = _fs(spark, f"{root}/pointers")
    if not fs.exists(where):
        return 0, None
    for name in sorted((s.getPath().getName() for s in fs.listStatus(where)), reverse=True):
        if name.isdigit() and (found := _read(spark, f"{root}/pointers/{name}")) is not None:
            return int(name), found
    return 0, None


def _claimed(spark: SparkSession, path: str) -> bool:
    """Whether this call made the file. Hadoop's local file system looks first and creates then, so there the system's own call is used."""
    where, fs = _fs(spark, path)
    fs.mkdirs(where.getParent())
    jvm = spark.sparkContext._jvm
    try:
        if fs.getUri().getScheme() == "file":
            jvm.java.nio.file.Files.createFile(jvm.java.nio.file.Paths.get(where.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)),
                                               spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
        else:
            fs.create(where, False).close()
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception):
            return False
        raise
    return True


def commit(spark: SparkSession, root: str, number: int, content: dict) -> bool:
    """Whether the pointer ``number`` is now this one; False if another writer has taken it."""
    path = f"{root}/pointers/{number:09d}"
    if not _claimed(spark, path):
        return False
    where, fs = _fs(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray((json.dumps(content) + "\n").encode()))
    finally:
        out.close()
    return True


def update(spark: SparkSession, root: str, change: Callable[[dict | None], dict], tries: int = 20) -> tuple[int, dict]:
    """Commits ``change`` of the newest content, again on newer content as long as other writers are faster."""
    for _ in range(tries):
        number, content = newest(spark, root)
        made = change(content)
        if commit(spark, root, number + 1, made):
            return number + 1, made
        time.sleep(0.05)
    raise RuntimeError(f"{tries} other writers were faster at {root}")
