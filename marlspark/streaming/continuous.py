"""A SELECT over streaming tables.

The dialect itself has no streams; this lets its SELECT run on them as it is.
Filters, columns and joins of a stream with tables at rest work in every output
mode; aggregates need the complete or update mode, and ORDER BY is not for
streams but for the complete mode. What Spark cannot run incrementally it
rejects when the query is started.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import InternalError, TableNotFoundError
from ..functions.types import ColumnDef
from ..plans import analyzer, parser, planner
from ..plans.statements import Select
from ..sources.files import columns_of


def continuous(text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The SELECT as a streaming DataFrame; ``tables`` may mix streams and tables at rest."""
    select = parser.parse(text)
    if not isinstance(select, Select):
        raise InternalError("only a SELECT can run on a stream")

    def columns(name: str) -> list[ColumnDef]:
        if name not in tables:
            raise TableNotFoundError(name)
        return columns_of(tables[name])

    return planner.plan(analyzer.analyze(select, columns), tables.__getitem__)
