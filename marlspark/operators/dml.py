"""INSERT, UPDATE and DELETE as new versions of a table, and its unique keys."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnNotFoundError, DuplicateKeyError, IncompatibleTypeError, InvalidValueCountError
from ..functions.types import ColumnDef, Kind, Literal, stored_value
from ..plans.analyzer import Scope
from ..plans.statements import Condition


def row_of(columns: tuple[ColumnDef, ...], values: list[Literal], lenient: bool = False) -> tuple:
    """The row that INSERT stores. ``lenient`` lets whole numbers into FLOAT columns, and fractions into INT ones."""
    if len(columns) != len(values):
        raise InvalidValueCountError(f"{len(values)} values for {len(columns)} columns")
    return tuple(stored_value(c, v, convert=lenient) for c, v in zip(columns, values, strict=True))


def matching(table: str, columns: tuple[ColumnDef, ...], where: list[Condition]) -> Column:
    """Whether a row, under the columns' own names, meets the conditions; nulls (in tables from files) do not."""
    scope = Scope({table: list(columns)})
    found = reduce(and_, [scope.predicate(c).column for c in where], F.lit(True))
    return F.coalesce(found, F.lit(False))


def check_sets(columns: tuple[ColumnDef, ...], sets: list[tuple[str, Literal]]) -> None:
    """Raises if a SET names no column or its value does not fit, whether a row is changed or not."""
    known = {c.name: c for c in columns}
    for name, literal in sets:
        if name not in known:
            raise ColumnNotFoundError(name)
        stored_value(known[name], literal, convert=True)


def files_with(table: str, columns: tuple[ColumnDef, ...], frame: DataFrame, where: list[Condition]) -> list[str]:
    """The files of ``frame`` that hold a row that meets the conditions, as URIs: the filter is pushed down, and only names come back."""
    hit = _in_scope(table, columns, frame).filter(matching(table, columns, where))
    return [r.file for r in hit.select(F.input_file_name().alias("file")).distinct().collect()]


def _in_scope(table: str, columns: tuple[ColumnDef, ...], frame: DataFrame) -> DataFrame:
    return Scope({table: list(columns)}).qualified(table, frame)


def deleted(table: str, columns: tuple[ColumnDef, ...], frame: DataFrame, where: list[Condition]) -> DataFrame:
    return _in_scope(table, columns, frame).filter(~matching(table, columns, where)).toDF(*(c.name for c in columns))


def updated(table: str, columns: tuple[ColumnDef, ...], frame: DataFrame, sets: list[tuple[str, Literal]], where: list[Condition], only: bool = False) -> DataFrame:
    """The rows after SET (with ``only`` just those that it changes); a column set twice takes the last value."""
    known = {c.name: c for c in columns}
    new: dict[str, Column] = {}
    for name, literal in sets:
        if name not in known:
            raise ColumnNotFoundError(name)
        new[name] = F.lit(stored_value(known[name], literal, convert=True)).cast(known[name].spark)
    hit = matching(table, columns, where)
    scope = _in_scope(table, columns, frame)
    if only:
        scope = scope.filter(hit)
    refs = {c.name: F.col(f"`{table}.{c.name}`") for c in columns}
    return scope.select(*(F.when(hit, new[c.name]).otherwise(refs[c.name]).alias(c.name) if c.name in new else refs[c.name].alias(c.name) for c in columns))


#: So many new keys (about 100 MB of them) are broadcast to the table they must not occur in; beyond, both sides are shuffled.
BROADCAST_KEYS = 1_000_000


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def check_new_keys(existing: DataFrame, added: DataFrame, index: tuple[str, ...]) -> None:
    """Raises if a key of ``added`` occurs there twice or in ``existing``, whose keys are read once and not shuffled if ``added`` is small."""
    check_unique(added, index)
    if not existing.select(*index).join(_small(added.select(*index)), list(index), "left_semi").isEmpty():
        raise DuplicateKeyError(f"a key of ({','.join(index)}) exists already")


def check_new_rows(existing: DataFrame, columns: tuple[ColumnDef, ...], rows: list[tuple], index: tuple[str, ...]) -> None:
    """``check_new_keys`` for a few rows: their values are a filter that reaches the files."""
    at = [next(i for i, c in enumerate(columns) if c.name == name) for name in index]
    keys = [tuple(r[i] for i in at) for r in rows]
    if len(set(keys)) < len(keys):
        raise DuplicateKeyError(f"keys of ({','.join(index)}) are not unique")
    found = existing.select(*index)
    for k, i in enumerate(at):
        found = found.filter(F.col(f"`{index[k]}`").isin(*(F.lit(v).cast(columns[i].spark) for v in sorted({key[k] for key in keys}))))
    if len(index) > 1 and len(keys) > 1:
        schema = T.StructType([columns[i].field() for i in at])
        found = found.join(F.broadcast(existing.sparkSession.createDataFrame(keys, schema)), list(index), "left_semi")
    if not found.isEmpty():
        raise DuplicateKeyError(f"a key of ({','.join(index)}) exists already")


def check_changed_keys(table: str, columns: tuple[ColumnDef, ...], frame: DataFrame, sets: list[tuple[str, Literal]], where: list[Condition], index: tuple[str, ...]) -> None:
    """Raises if an update gives a row a key that another row has.

    SET has literals only, so new keys can meet only one another and rows that
    have these literals already: no other row is looked at.
    """
    known = {c.name: c for c in columns}
    fixed = {n: F.lit(stored_value(known[n], v, convert=True)).cast(known[n].spark) for n, v in sets if n in index}
    changed = updated(table, columns, frame, sets, where, only=True).select(*index)
    check_unique(changed, index)
    others = deleted(table, columns, frame, where)
    for name, value in fixed.items():
        others = others.filter(F.col(f"`{name}`") == value)
    if not others.select(*index).join(_small(changed), list(index), "left_semi").isEmpty():
        raise DuplicateKeyError(f"a key of ({','.join(index)}) exists already")


def check_unique(frame: DataFrame, index: tuple[str, ...]) -> None:
    if not frame.groupBy(*index).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        raise DuplicateKeyError(f"keys of ({','.join(index)}) are not unique")


def conform(columns: tuple[ColumnDef, ...], frame: DataFrame) -> DataFrame:
    """A DataFrame to insert, in the table's columns and types; an over-long CHAR value is an error in the tasks."""
    missing = [c.name for c in columns if c.name not in frame.columns]
    if missing:
        raise InvalidValueCountError(f"no column {', '.join(missing)}")
    out = []
    for c in columns:
        ref = F.col(f"`{c.name}`")
        if c.kind not in (Kind.CHAR, Kind.STRING) and frame.schema[c.name].dataType.simpleString() == "string" and c.kind is not Kind.DATETIME:
            raise IncompatibleTypeError(f"{c.name} is {c.kind.value}, the rows have text")
        value = ref.cast(c.spark)
        if c.kind is Kind.CHAR:
            value = F.when(F.octet_length(value) > c.length, F.raise_error(F.lit(f"{c.name}: over CHAR({c.length})")).cast("string")).otherwise(value)
        out.append(value.alias(c.name))
    return frame.select(*out)
