"""Paths in the folder that all machines share, and a few file operations by Spark's own file systems."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder (spark.checkpoint.dir); where that is unset, a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="strandmill-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def located(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's interface."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = located(spark, path)
    return system.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    system, target = located(spark, path)
    system.delete(target, True)


def claim(spark: SparkSession, path: str) -> bool:
    """Creates an empty file; False if it is there already. Of several claimants one succeeds."""
    system, target = located(spark, path)
    system.mkdirs(target.getParent())
    return system.createNewFile(target)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, by way of the driver, from any file system."""
    system, target = located(spark, path)
    stream = system.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, lines) -> None:
    """Lines to one file, by way of the driver, on any file system."""
    system, target = located(spark, path)
    out = spark.sparkContext._jvm.java.io.BufferedOutputStream(system.create(target, True))
    try:
        for line in lines:
            out.write(bytearray(f"{line}\n".encode()))
    finally:
        out.close()


def join_files(spark: SparkSession, folder: str, path: str) -> bool:
    """The part files of a folder as one file, in the order of their names; False, and no file, if they are empty.

    Their bytes pass from stream to stream on the driver, and are not read there.
    """
    system, source = located(spark, folder)
    parts = sorted((f.getPath().getName(), f) for f in system.listStatus(source) if f.getPath().getName().startswith("part-") and f.getLen())
    if not parts:
        return False
    to, target = located(spark, path)
    out = to.create(target, True)
    try:
        for _, part in parts:
            stream = system.open(part.getPath())
            try:
                spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            finally:
                stream.close()
    finally:
        out.close()
    return True
