"""Whole-table aggregates."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.types import Kind
from ..plans.analyzer import Resolved
from ..plans.statements import Aggregate


def aggregate(item: Aggregate, column: Resolved | None) -> Column:
    """Sums are BIGINT, DECIMAL or DOUBLE and 0 over no rows, as counts are; MAX and MIN over no rows are null."""
    if column is None:
        return F.count(F.lit(1))
    ref = column.ref()
    if item.function == "COUNT":
        return F.count(ref)
    if item.function == "SUM":
        kind = column.definition.kind
        zero = F.lit(0).cast("long") if kind in (Kind.INT, Kind.BIGINT) else F.lit(Decimal(0)) if kind is Kind.DECIMAL else F.lit(0.0)
        return F.coalesce(F.sum(ref), zero)
    return F.max(ref) if item.function == "MAX" else F.min(ref)
