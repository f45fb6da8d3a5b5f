"""Column types of the dialect, their Spark types, and the coercion of literals.

INT, BIGINT, FLOAT, CHAR(n) and DATETIME are the dialect's own. DOUBLE, STRING
(text of any length), DATE, TIMESTAMP (an instant, written in the session's time
zone), DECIMAL and BOOL describe columns of tables that come from files.
"""

from __future__ import annotations

import math
import operator
import re
import struct
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DatetimeError, IncompatibleTypeError, IntegerRangeError, InvalidColLengthError, InvalidRecordSizeError, StringOverflowError

# Limits of the dialect.
INT_RANGE = (-(2**31), 2**31 - 1)
BIGINT_RANGE = (-(2**63), 2**63 - 1)
MAX_RECORD_BYTES = 512


class Kind(Enum):
    INT = "INT"
    BIGINT = "BIGINT"
    FLOAT = "FLOAT"
    CHAR = "CHAR"
    DATETIME = "DATETIME"
    DOUBLE = "DOUBLE"
    STRING = "STRING"
    DATE = "DATE"
    TIMESTAMP = "TIMESTAMP"
    DECIMAL = "DECIMAL"
    BOOL = "BOOL"


SPARK = {Kind.DATE: T.DateType(), Kind.TIMESTAMP: T.TimestampType(), Kind.BOOL: T.BooleanType(), Kind.INT: T.IntegerType(), Kind.BIGINT: T.LongType(), Kind.FLOAT: T.FloatType(), Kind.CHAR: T.StringType(), Kind.DATETIME: T.TimestampNTZType(), Kind.DOUBLE: T.DoubleType(), Kind.STRING: T.StringType()}
NUMERIC = {Kind.INT, Kind.BIGINT, Kind.FLOAT, Kind.DOUBLE, Kind.DECIMAL}
TIMES = {Kind.DATETIME, Kind.TIMESTAMP, Kind.DATE}
TEXT = {Kind.CHAR, Kind.STRING}
# Bytes that a value takes.
WIDTH = {Kind.INT: 4, Kind.BIGINT: 8, Kind.FLOAT: 4, Kind.DATETIME: 8, Kind.DOUBLE: 8, Kind.STRING: 0, Kind.DATE: 4, Kind.TIMESTAMP: 8, Kind.DECIMAL: 16, Kind.BOOL: 1}

OPERATORS: dict[str, Callable[[Column, Column], Column]] = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: Kind
    length: int = 0  # of CHAR; of DECIMAL its digits
    scale: int = 0

    @property
    def width(self) -> int:
        return self.length if self.kind is Kind.CHAR else WIDTH[self.kind]

    def field(self) -> T.StructField:
        return T.StructField(self.name, self.spark, True, {"kind": self.kind.value, "length": self.length})

    @property
    def spark(self) -> T.DataType:
        return T.DecimalType(self.length, self.scale) if self.kind is Kind.DECIMAL else SPARK[self.kind]


@dataclass(frozen=True)
class Literal:
    """A literal as written: int, float, str or bool."""

    value: int | float | str | bool

    @property
    def kind(self) -> Kind | None:
        if isinstance(self.value, bool):
            return None
        if isinstance(self.value, int):
            return Kind.INT if INT_RANGE[0] <= self.value <= INT_RANGE[1] else Kind.BIGINT
        return Kind.FLOAT if isinstance(self.value, float) else Kind.CHAR


def check_columns(columns: list[ColumnDef]) -> None:
    """Raises if a CHAR has no length or a record would be too wide."""
    for c in columns:
        if c.kind is Kind.CHAR and c.length < 1:
            raise InvalidColLengthError(f"{c.name}: length {c.length}")
    if (width := sum(c.width for c in columns)) > MAX_RECORD_BYTES or not columns:
        raise InvalidRecordSizeError(f"a record of {width} bytes")


def kind_of(spark_type: T.DataType) -> Kind | None:
    """The column kind of a file's column, or None if the dialect has none for it."""
    found = {T.ByteType: Kind.INT, T.ShortType: Kind.INT, T.IntegerType: Kind.INT, T.LongType: Kind.BIGINT, T.FloatType: Kind.FLOAT, T.DoubleType: Kind.DOUBLE, T.StringType: Kind.STRING, T.TimestampNTZType: Kind.DATETIME, T.DateType: Kind.DATE, T.TimestampType: Kind.TIMESTAMP, T.DecimalType: Kind.DECIMAL, T.BooleanType: Kind.BOOL}
    return found.get(type(spark_type))


def column_of(field: T.StructField) -> ColumnDef | None:
    """The column definition for a file's column, or None if the dialect has no kind for it."""
    kind = kind_of(field.dataType)
    if kind is Kind.DECIMAL:
        return ColumnDef(field.name, kind, field.dataType.precision, field.dataType.scale)
    return kind and ColumnDef(field.name, kind)


def parse_datetime(text: str) -> datetime:
    """Strictly ``YYYY-MM-DD HH:MM:SS`` of a real date from year 1000 on."""
    if not re.fullmatch(r"[1-9][0-9]{3}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}", text, re.A):
        raise DatetimeError(f"Invalid datetime: {text}")
    try:
        return datetime.strptime(text, "%Y-%m-%d %H:%M:%S")
    except ValueError:
        raise DatetimeError(f"Invalid datetime: {text}") from None


def parse_date(text: str) -> date:
    return parse_datetime(f"{text} 00:00:00").date()


def _moment(column: ColumnDef, text: str) -> datetime | date:
    """The literal for a column of times; a DATE column takes a day, or compares with a time of day."""
    return parse_date(text) if column.kind is Kind.DATE else parse_datetime(text)


def _text(value: str, column: ColumnDef) -> str:
    if column.kind is Kind.CHAR and len(value.encode()) > column.length:
        raise StringOverflowError(f"{column.name}: {len(value.encode())} bytes in CHAR({column.length})")
    return value


def _integer(value: int, column: ColumnDef) -> int:
    low, high = INT_RANGE if column.kind is Kind.INT else BIGINT_RANGE
    if not low <= value <= high:
        raise IntegerRangeError(f"{column.name}: {value} is out of range")
    return value


def _incompatible(column: ColumnDef, literal: Literal) -> IncompatibleTypeError:
    return IncompatibleTypeError(f"{column.name} is {column.kind.value}, the value is {literal.value!r}")


def to_float32(value: float) -> float:
    try:
        return struct.unpack("f", struct.pack("f", value))[0]
    except OverflowError:
        return float("inf") if value > 0 else float("-inf")


def stored_value(column: ColumnDef, literal: Literal, convert: bool) -> object:
    """The value that INSERT (``convert`` false) or UPDATE (true) stores for the literal.

    INSERT takes a number of the column's own sort only: an integer for INT and
    BIGINT, one with a point for FLOAT. UPDATE converts, cutting off fractions.
    """
    value, kind = literal.value, literal.kind
    if column.kind in TIMES and kind is Kind.CHAR:
        return _moment(column, value)
    if column.kind in TEXT and kind is Kind.CHAR:
        return _text(value, column)
    if column.kind is Kind.BOOL and kind is None:
        return value
    if kind in NUMERIC:
        if column.kind is Kind.DECIMAL:
            rounded = round(Decimal(str(value)), column.scale)
            if abs(rounded) >= Decimal(10) ** (column.length - column.scale):
                raise IntegerRangeError(f"{column.name}: {value} is out of range")
            return rounded
        if column.kind in (Kind.INT, Kind.BIGINT):
            if kind is not Kind.FLOAT:
                return _integer(value, column)
            if convert:
                return _integer(int(value), column)
        elif column.kind is Kind.DOUBLE:
            return float(value)
        elif column.kind is Kind.FLOAT and (convert or kind is Kind.FLOAT):
            return to_float32(float(value))
    raise _incompatible(column, literal)


def compared(column: ColumnDef, ref: Column, literal: Literal, op: str) -> Column:
    """The comparison of a column with a literal, with the column as it is: so it can be pushed down to the files.

    The literal takes the column's type, so FLOAT compares in 32 bits and a
    fraction is cut off for INT. A fraction is folded for BIGINT (``< 7.5`` is
    ``<= 7``, ``= 7.5`` is false), and a literal that the type cannot hold makes
    the comparison true or false for all values.
    """
    value, kind = literal.value, literal.kind
    compare = OPERATORS[op]
    if column.kind in TIMES and kind is Kind.CHAR:
        if column.kind is Kind.DATE and len(value) > 10:
            # a day against a time of day: the day begins at midnight
            moment = parse_datetime(value)
            exact = moment.time() == datetime.min.time()
            return _whole(ref, op, moment.date(), exact, column)
        return compare(ref, F.lit(_moment(column, value)).cast(column.spark))
    if column.kind in TEXT and kind is Kind.CHAR:
        return compare(ref, F.lit(_text(value, column)))
    if column.kind is Kind.BOOL and kind is None and op in ("=", "<>"):
        return compare(ref, F.lit(value))
    if kind in NUMERIC:
        if column.kind is Kind.DOUBLE:
            return compare(ref, F.lit(float(value)))
        if column.kind is Kind.FLOAT:
            return compare(ref, F.lit(float(value)).cast("float"))
        if column.kind is Kind.DECIMAL:
            return compare(ref, F.lit(Decimal(str(value))))
        if column.kind in (Kind.INT, Kind.BIGINT):
            whole = int(value) if column.kind is Kind.INT else math.floor(value)
            return _whole(ref, op, whole, column.kind is Kind.INT or whole == value, column)
    raise _incompatible(column, literal)


def _whole(ref: Column, op: str, floor: int | date, exact: bool, column: ColumnDef) -> Column:
    """``ref op x`` for a column of whole steps; ``floor`` is x rounded down, ``exact`` whether it is x."""
    low, high = {Kind.INT: INT_RANGE, Kind.BIGINT: BIGINT_RANGE}.get(column.kind, (floor, floor))
    always = ref.isNotNull()
    if floor < low:
        return always if op in (">", ">=", "<>") else F.lit(False)
    if floor > high:
        return always if op in ("<", "<=", "<>") else F.lit(False)
    if not exact:
        if op in ("=", "<>"):
            return always if op == "<>" else F.lit(False)
        op = "<=" if op in ("<", "<=") else ">"
    return OPERATORS[op](ref, F.lit(floor).cast(column.spark))


def comparable(left: ColumnDef, a: Column, right: ColumnDef, b: Column) -> tuple[Column, Column]:
    """Both sides of a comparison of two columns, in their common type."""
    kinds = {left.kind, right.kind}
    if left.kind is right.kind or kinds <= TEXT:
        return a, b
    if kinds <= TIMES:
        return a.cast("timestamp_ntz"), b.cast("timestamp_ntz")
    if not kinds <= NUMERIC:
        raise IncompatibleTypeError(f"{left.name} is {left.kind.value}, {right.name} is {right.kind.value}")
    if Kind.DECIMAL in kinds and not kinds & {Kind.DOUBLE, Kind.FLOAT}:
        return a, b
    common = "double" if Kind.DOUBLE in kinds else "float" if Kind.FLOAT in kinds else "long"
    return a.cast(common), b.cast(common)


