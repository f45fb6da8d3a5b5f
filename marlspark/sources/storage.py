"""Files of tables: on whatever file system Spark reaches, never by the driver's own open()."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

#: Used where spark.checkpoint.dir is unset and the master is local, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/marlspark"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    A local session without that setting gets ``LOCAL_CHECKPOINTS``; a cluster
    without it is an error, as a machine's own folder would lose data there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = LOCAL_CHECKPOINTS
    return found.rstrip("/")


def path_of(spark: SparkSession, path: str) -> JavaObject:
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def filesystem(spark: SparkSession, path: str) -> JavaObject:
    return path_of(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Spark names files."""
    return filesystem(spark, path).makeQualified(path_of(spark, path)).toString()


def plain_path(spark: SparkSession, uri: str) -> str:
    """The path that a file's URI, as Spark gives it, stands for."""
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri)).toString()


def exists(spark: SparkSession, path: str) -> bool:
    return filesystem(spark, path).exists(path_of(spark, path))


def delete(spark: SparkSession, path: str) -> None:
    filesystem(spark, path).delete(path_of(spark, path), True)


def children(spark: SparkSession, path: str) -> list[str]:
    return [s.getPath().getName() for s in filesystem(spark, path).listStatus(path_of(spark, path))] if exists(spark, path) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    return filesystem(spark, path).getContentSummary(path_of(spark, path)).getLength()


def make_dirs(spark: SparkSession, path: str) -> None:
    filesystem(spark, path).mkdirs(path_of(spark, path))


def read_text(spark: SparkSession, path: str) -> str:
    stream = filesystem(spark, path).open(path_of(spark, path))
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes the text beside ``path`` and renames it over: readers see the old file or the new one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    beside = path_of(spark, f"{path}.{uuid.uuid4().hex}")
    out = filesystem(spark, path).create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    target = filesystem(spark, path).makeQualified(path_of(spark, path))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(filesystem(spark, path).makeQualified(beside), target, options)


#: The scratch folders of this process that are still there; in a scope, those made in it.
_MADE: set[str] = set()
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted by ``release`` or when the session's JVM ends."""
    path = f"{shared_dir(spark)}/marlspark-{label}-{uuid.uuid4().hex}"
    make_dirs(spark, path)
    filesystem(spark, path).deleteOnExit(path_of(spark, path))
    _MADE.add(path)
    if (made := _SCOPE.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch folders that are made in it at its end, when what was read from them has been used up."""
    outer, made = _SCOPE.get(), []
    _SCOPE.set(made)
    try:
        yield
    finally:
        _SCOPE.set(outer)
        for path in made:
            _MADE.discard(path)
            delete(spark, path)


def release(spark: SparkSession) -> int:
    """Deletes all scratch folders made so far, and says how many: for a long driver, once it has used the results that were read from them."""
    done = [_MADE.pop() for _ in range(len(_MADE))]
    for path in done:
        delete(spark, path)
    return len(done)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and lost executors cost no rerun."""
    path = scratch(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
