"""Parsed statements."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.types import ColumnDef, Literal


@dataclass(frozen=True)
class ColumnRef:
    name: str
    table: str = ""

    def __str__(self) -> str:
        return f"{self.table}.{self.name}" if self.table else self.name


@dataclass(frozen=True)
class Condition:
    left: ColumnRef
    op: str
    right: ColumnRef | Literal


@dataclass(frozen=True)
class Aggregate:
    function: str  # SUM, MAX, MIN, COUNT
    column: ColumnRef | None  # None: COUNT(*)
    alias: str = ""

    @property
    def caption(self) -> str:
        return self.alias or (self.column.name if self.column else "")


@dataclass(frozen=True)
class OrderKey:
    column: ColumnRef
    descending: bool = False


@dataclass(frozen=True)
class Select:
    tables: list[str]
    columns: list[ColumnRef | Aggregate] | None  # None: all
    where: list[Condition] = field(default_factory=list)
    order: list[OrderKey] = field(default_factory=list)
    limit: int = 0  # 0 or less: none


@dataclass(frozen=True)
class Insert:
    table: str
    values: list[Literal]


@dataclass(frozen=True)
class Delete:
    table: str
    where: list[Condition]


@dataclass(frozen=True)
class Update:
    table: str
    sets: list[tuple[str, Literal]]
    where: list[Condition]


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: list[ColumnDef]


@dataclass(frozen=True)
class DropTable:
    table: str


@dataclass(frozen=True)
class DescTable:
    table: str


@dataclass(frozen=True)
class CreateIndex:
    table: str
    columns: list[str]


@dataclass(frozen=True)
class DropIndex:
    table: str
    columns: list[str]


@dataclass(frozen=True)
class ShowTables:
    pass


@dataclass(frozen=True)
class ShowIndex:
    table: str


@dataclass(frozen=True)
class SetKnob:
    knob: str
    on: bool


@dataclass(frozen=True)
class Control:
    action: str  # BEGIN, COMMIT, ABORT, HELP, EXIT, EMPTY, CRASH
