"""Texts of results: the lines of the result file and the client's table."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from decimal import Decimal

# The client's cells and its buffer.
CELL = 16
BUFFER, RESERVED = 8192, 40


def text_of(value: object) -> str:
    """Whole numbers plain, fractions with six decimals, times to the second; a missing value is empty."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value:.6f}"
    if isinstance(value, datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S").zfill(19)
    if isinstance(value, Decimal):
        return f"{value:f}"
    return str(value)


def file_line(cells: Iterable[str]) -> str:
    return "|" + "".join(f" {c} |" for c in cells)


def file_lines(header: list[str], rows: Iterable[Iterable[object]]) -> list[str]:
    return [file_line(header), *(file_line(map(text_of, r)) for r in rows)]


def rows_shown(columns: int) -> int:
    """More rows than the client's buffer can hold, so that no more need be fetched."""
    return BUFFER // (columns * (CELL + 3)) + 2


def client_table(header: list[str], rows: Iterable[Iterable[object]], total: int | None = None) -> str:
    """The table as the client shows it; pieces that the buffer cannot hold are left out, and ``... ...`` says so.

    ``total`` is the number of all rows, of which the first will do; without it no count is shown.
    """
    out: list[str] = []
    used, full = 0, False

    def put(piece: str, marks: bool = True) -> None:
        nonlocal used, full
        size = len(piece.encode())
        if not full and used + RESERVED + size < BUFFER:
            out.append(piece)
            used += size
        elif marks:
            full = True

    def rule() -> None:
        for _ in header:
            put("+" + "-" * (CELL + 2))
        put("+\n")

    def line(cells: Iterable[str]) -> None:
        for c in cells:
            put(f"| {c if len(c) <= CELL else c[: CELL - 3] + '...':>{CELL}} ")
        put("|\n", marks=False)

    rule()
    line(header)
    rule()
    for row in rows:
        line(map(text_of, row))
    rule()
    if total is not None:
        out.append("... ...\n" * full + f"Total record(s): {total}\n")
    return "".join(out)
