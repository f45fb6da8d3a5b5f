"""Tables from files: Parquet with its own schema, CSV with a declared one."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.types import ColumnDef, column_of
from . import storage

log = logging.getLogger(__name__)


def columns_of(frame: DataFrame) -> list[ColumnDef]:
    """The columns that have a kind in the dialect, in their order.

    Those without (arrays, maps, structs, binary) are left out and named in a warning.
    """
    found = {f.name: column_of(f) for f in frame.schema}
    if none := [n for n, c in found.items() if c is None]:
        log.warning("no type in the dialect for the columns %s: they are left out", ", ".join(none))
    return [c for c in found.values() if c is not None]


#: Schemas of single files, by path, time of change and length: a file that has not changed is not asked again.
_SCHEMAS: dict[tuple[str, int, int], T.StructType] = {}


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files with the schema that they have."""
    status = storage.filesystem(spark, path).getFileStatus(storage.path_of(spark, path)) if not set(path) & set("*?[{") and storage.exists(spark, path) else None
    if status is None or not status.isFile():
        return spark.read.parquet(path)
    key = status.getPath().toString(), status.getModificationTime(), status.getLen()
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def csv_frame(spark: SparkSession, path: str, columns: list[ColumnDef]) -> DataFrame:
    """A CSV with a header line, in the declared types; a value that does not fit its type is an error."""
    schema = T.StructType([T.StructField(c.name, c.field().dataType) for c in columns])
    return spark.read.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path, header=True, schema=schema, mode="FAILFAST")
