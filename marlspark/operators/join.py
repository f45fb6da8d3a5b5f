"""Inner joins of a FROM list: equi, theta and cross, in an order that the predicates allow."""

from __future__ import annotations

from functools import reduce
from math import prod
from operator import and_

from pyspark.sql import Column, DataFrame

from ..errors import InternalError
from ..plans.analyzer import Predicate


#: A product of unconnected tables that may be larger, by the sizes of their files, is dealt out and its larger side streamed.
LARGE_PRODUCT = 256 << 20
#: Of tables: a smaller one has fewer splits of its own than a product's tasks (as many bytes as Spark gives a split at least).
SPLIT_BYTES = 4 << 20
#: Tasks of a large product for each core.
WAVES = 3


def joined(frames: dict[str, DataFrame], predicates: list[Predicate], nestloop: bool = True, sortmerge: bool = False) -> DataFrame:
    """All tables joined by the predicates over two of them; each of one table must be applied before.

    Tables that predicates connect are joined first, equalities before other
    comparisons, so that no product is formed that a predicate could avoid; what
    is left unconnected is crossed last. ``sortmerge`` asks for sort-merge joins
    where there is an equality; without it Spark chooses by size.
    """
    pairs = [p for p in predicates if len(p.tables) == 2]
    if pairs and not (nestloop or sortmerge):
        raise InternalError("No join executor selected!")
    groups = _connected(frames, pairs, sortmerge and not nestloop)
    if len(groups) > 1 and not any(f.isStreaming for f in frames.values()):
        size = {name: _bytes(frame) for name, frame in frames.items()}
        if prod(max(map(size.get, names)) for names, _ in groups) >= LARGE_PRODUCT:
            return _crossed(frames, pairs, sortmerge and not nestloop, size)
    return reduce(lambda a, b: a.crossJoin(b), [frame for _, frame in groups])


def _connected(frames: dict[str, DataFrame], left: list[Predicate], merge: bool) -> list[tuple[set[str], DataFrame]]:
    """The groups of tables that the predicates connect, each joined, with their names."""
    groups: list[tuple[set[str], DataFrame]] = [({name}, frame) for name, frame in frames.items()]
    while left:
        step = next((p for p in left if p.equal), left[0])
        first, second = (next(g for g in groups if t in g[0]) for t in sorted(step.tables, key=list(frames).index))
        names = first[0] | second[0]
        now = [p for p in left if p.tables <= names and not any(p.tables <= g[0] for g in (first, second))]
        left = [p for p in left if not p.tables <= names]
        on: Column = reduce(and_, [p.column for p in now])
        other = second[1].hint("merge") if merge and any(p.equal for p in now) else second[1]
        groups = [(names, first[1].join(other, on, "inner")) if g is first else g for g in groups if g is not second]
    return groups


def _crossed(frames: dict[str, DataFrame], pairs: list[Predicate], merge: bool, size: dict[str, int]) -> DataFrame:
    """A large product: the group of the largest table is streamed by all cores, past the others.

    A product without a broadcast holds its right side, so the largest group must
    not stand there. Spark takes a join for as large as the product of its tables
    and so broadcasts none; a joined group is shuffled, by which its true size is
    known when Spark chooses between a broadcast and a product of partitions.
    """
    largest, tasks = max(size, key=size.get), WAVES * next(iter(frames.values())).sparkSession.sparkContext.defaultParallelism
    if size[largest] < tasks * SPLIT_BYTES:
        frames = frames | {largest: frames[largest].repartition(tasks)}
    groups = sorted(_connected(frames, pairs, merge), key=lambda g: max(map(size.get, g[0])), reverse=True)
    return reduce(lambda a, b: a.crossJoin(b), [groups[0][1], *(frame.hint("rebalance") if len(names) > 1 else frame for names, frame in groups[1:])])


def _bytes(frame: DataFrame) -> int:
    """Spark's estimate: of a table its files' bytes."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
