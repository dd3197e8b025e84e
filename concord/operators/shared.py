"""What is kept between jobs, in a folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the context or spark.checkpoint.dir names. One is made only in local mode, where there is just one machine."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="spark-shared-")


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors lose nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


# names that only one job can take


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def claim(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Makes a file of this name and text unless there is one: of several jobs that try, one alone gets True, and none ever sees half a text.

    The text is written elsewhere and then gets its name: by a link on a local disk, by a rename on a store whose renames refuse a name that
    is taken (as HDFS does).
    """
    files, own = _at(spark, f"{folder}/.new-{uuid.uuid4().hex}")
    out = files.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    target = _at(spark, f"{folder}/{name}")[1]
    try:
        if files.getUri().getScheme() != "file":
            return not files.exists(target) and files.rename(own, target)
        os.link(own.toUri().getPath(), target.toUri().getPath())
        return True
    except FileExistsError:
        return False
    finally:
        if files.exists(own):
            files.delete(own, False)


def claims(spark: SparkSession, folder: str) -> dict[str, str]:
    """Names that are taken in a folder, in order, with their texts."""
    files, at = _at(spark, folder)
    if not files.exists(at):
        return {}
    names = sorted(f.getPath().getName() for f in files.listStatus(at) if not f.getPath().getName().startswith("."))
    read = spark._jvm.org.apache.commons.io.IOUtils.toString

    def text(name: str) -> str:
        stream = files.open(_at(spark, f"{folder}/{name}")[1])
        try:
            return read(stream, "UTF-8")
        finally:
            stream.close()

    return {n: text(n) for n in names}
