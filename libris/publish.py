"""Small files that appear whole, under a name that nobody else has taken."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def publish(spark: SparkSession, to: str, content: str) -> bool:
    """Makes ``content`` the file ``to``; False, and nothing changed, if there is such a file.

    Of several writers of one name exactly one gets True, and readers see its whole
    content or no file: the file is written aside and then linked (local and network folders) or
    renamed without overwriting (other file systems) to its name.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    target = path(to)
    fs = target.getFileSystem(conf)
    target = fs.makeQualified(target)
    aside = path(target.getParent().getParent(), f".aside-{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    out = fs.create(aside, False)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    try:
        if target.toUri().getScheme() == "file":
            files = jvm.java.nio.file
            files.Files.createLink(files.Paths.get(target.toUri()), files.Paths.get(aside.toUri()))
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(aside, target, none)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
            raise
        return False
    finally:
        fs.delete(aside, False)
    return True
