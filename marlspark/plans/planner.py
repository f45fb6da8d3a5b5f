"""A resolved SELECT as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.aggregate import aggregate
from ..operators.join import joined
from ..operators.sort import limited, ordered
from .analyzer import Query


def plan(query: Query, frame_of: Callable[[str], DataFrame], nestloop: bool = True, sortmerge: bool = False) -> DataFrame:
    """Filters first, then joins, order, limit and the columns asked for; of aggregates the limit comes last.

    Catalyst pushes the filters and the column list into the scans. Several
    result columns may have one name, as in the statement.
    """
    frames = {}
    for table in query.scope.tables:
        frame = query.scope.qualified(table, frame_of(table))
        for p in query.predicates:
            if p.tables == {table}:
                frame = frame.filter(p.column)
        frames[table] = frame
    rows = joined(frames, query.predicates, nestloop, sortmerge)
    if query.aggregates:
        found = rows.agg(*(aggregate(i, c).alias(f"a{n}") for n, (i, c) in enumerate(query.aggregates)))
        return limited(found, query.limit).toDF(*query.captions)
    rows = limited(ordered(rows, query.order), query.limit)
    return rows.select(*(c.ref().alias(name) for c, name in zip(query.columns, query.captions, strict=True)))
