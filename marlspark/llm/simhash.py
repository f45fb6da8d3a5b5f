"""SimHash near-duplicates: exact tiled comparison with exclusive-or and bit counts.

Fingerprint: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, 3-word
shingles (a shorter text is one shingle), XXH64 with seed 42 of each; a bit is 1
if it is set in more than half of the shingles' hashes.

Links: two fingerprints link at ``radius`` or fewer differing bits. Distinct
fingerprints are dealt out by ``radius + 1`` blocks of their bits: a pair within
the radius agrees in one block at least, so comparing inside each block's groups
is exact. A group larger than ``tile`` is cut into tiles, and each pair of tiles
is a task of its own. A task puts the fingerprints of all its groups in the order
of group and population count and compares tile with tile in numpy, by
exclusive-or and bit counts, skipping pairs of tiles whose population counts differ
by more than the radius; it returns a spanning forest of its links, never all pairs.

Defined cases: a null text is empty; an empty text has the fingerprint zero and
links like any other. Every row is a node of its own, repeated ones too, and
component_id is the smallest doc_id among the rows it reaches (a null doc_id
counts for nothing there; null if there are only such). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, components, fresh, join_hot, row_key, sieve, sifted, text_hash, utf8, written

SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = text.translate(_LOWER).split()  # of bytes: at 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    # where each word starts and ends in the joined text
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):  # bounded memory for very long texts
        hi = min(n, lo + 65536)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[lo:hi].tolist(), ends[lo + shingle - 1 : hi + shingle - 1].tolist(), strict=True)), np.uint64, hi - lo)
        ones += bit_sums(hashes)
    return int(sum(1 << i for i in range(64) if 2 * ones[i] > n))


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, from bit 0."""
    spread = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # sums of up to 255 rows fit a byte: most of the work is done in bytes
    out = np.zeros(64, np.int64)
    full = len(spread) // 255 * 255
    if full:
        out += np.add.reduce(spread[:full].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return out + spread[full:].sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, a hash of the text, and the fingerprint as a signed long."""

    def batch(rows: pa.RecordBatch) -> dict:
        found = np.array([fingerprint(t, shingle) for t in rows.column("text").to_pylist()], np.uint64)
        return {"doc_id": rows.column("doc_id"), "th": rows.column("th"), "print": pa.array(found.view(np.int64))}

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), utf8("text")), batch, "doc_id long, th long, print long")


def tiled_links(prints: np.ndarray, groups: np.ndarray, radius: int, tile: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of ``prints`` (unsigned, distinct within a group) inside each group: two arrays of fingerprints.

    Exact: the fingerprints are put in the order of group and population count and
    cut into tiles; each tile is compared as a whole with itself and with those
    after it, up to the first that has none of its groups or whose population
    counts are beyond the radius.
    """
    counts = np.bitwise_count(prints).astype(np.int64)
    order = np.lexsort((counts, groups))
    prints, counts, groups = prints[order], counts[order], groups[order]
    n, parent, found = len(prints), np.arange(len(prints)), []

    def roots(at: np.ndarray) -> np.ndarray:
        up = parent[at]
        while not np.array_equal(further := parent[up], up):
            up = further
        return up

    for a in range(0, n, tile):
        x, gx, last = prints[a : a + tile], groups[a : a + tile], min(a + tile, n) - 1
        for b in range(a, n, tile):
            if groups[b] > groups[last] or (b > a and counts[b] - counts[last] > radius):
                break
            near = np.bitwise_count(x[:, None] ^ prints[None, b : b + tile]) <= radius
            near &= gx[:, None] == groups[None, b : b + tile]
            i, j = np.nonzero(np.triu(near, 1) if a == b else near)
            i, j = i + a, j + b
            # all pairs of the two tiles at once: each round joins, for every row, what its first pair still leaves apart
            while len(i):
                apart = roots(i) != roots(j)
                i, j = i[apart], j[apart]
                for k in np.unique(i, return_index=True)[1].tolist():
                    u, v = (int(roots(np.array([at]))[0]) for at in (i[k], j[k]))
                    if u != v:  # happens n - 1 times at most
                        parent[max(u, v)] = min(u, v)
                        found.append((i[k], j[k]))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return prints[pairs[:, 0]], prints[pairs[:, 1]]


def forest(prints: np.ndarray, radius: int, sub: int = 256) -> list[tuple[int, int]]:
    """``tiled_links`` of one group, as a list of pairs."""
    a, b = tiled_links(prints, np.zeros(len(prints), np.int64), radius, sub)
    return list(zip(a.tolist(), b.tolist(), strict=True))


def links(prints: DataFrame, radius: int = 3, tile: int = 2048) -> DataFrame:
    """Links between distinct fingerprints of ``prints(print long)``: ``(a, b)``, enough to connect every linked pair."""
    blocks = radius + 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = [F.shiftrightunsigned("print", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) * blocks + i for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
    keyed = prints.select("print", F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy("key").count().filter("count > 1").select("key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    cut = keyed.join(sizes, "key").withColumn("tile", F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int"))
    # a group of one tile is a task; of more, each pair of tiles is one: (i, j), i < j
    other = F.when(F.col("tiles") == 1, F.array(F.col("tile"))).otherwise(F.expr("filter(sequence(0, tiles - 1), x -> x <> tile)"))
    dealt = cut.withColumn("other", F.explode(other)).select("key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "print")
    grouped = dealt.groupBy("key", "i", "j").agg(F.collect_list("print").alias("prints")).filter("size(prints) > 1").select("prints")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values, ends = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy()
            ends = ends - ends[0]
            # all groups of a batch go through the same tiles, however small they are
            for lo, hi in _slices(ends, 1 << 18):
                sizes = np.diff(ends[lo : hi + 1])
                a, b = tiled_links(values[ends[lo] : ends[hi]], np.repeat(np.arange(hi - lo), sizes), radius)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

    return grouped.mapInArrow(run, "a long, b long")


def _slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Groups (first, behind the last) with about ``most`` values together, one at least."""
    lo = 0
    while lo < len(ends) - 1:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def grouped(docs: DataFrame, radius: int = 3, shingle: int = 3, tile: int = 2048) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, th (a hash of the text), print, root (names the component) and component_id."""
    found = written(fingerprints(docs, shingle), "simhash-prints")
    # one row for each fingerprint, whatever the number of copies
    nodes = written(found.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    roots = components(links(nodes.select("print"), radius, tile), "simhash-links")
    placed = nodes.join(roots, nodes["print"] == roots["node"], "left").select("print", "least", "n", F.coalesce("root", "print").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    owned = written(placed.join(smallest, "root").select("print", "root", "component_id", "n"), "simhash-owned")
    return join_hot(found, owned, ["print"], "n")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, tile: int = 2048) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: fingerprint (16 hex digits) and component_id (the smallest doc_id reachable)."""
    return grouped(docs, radius, shingle, tile).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 3, shingle: int = 3, tile: int = 2048) -> DataFrame:
    """One row of ``docs(doc_id, text, ...)`` for each component: that of the smallest doc_id.

    Of several rows with that doc_id the one with the least hash of its text
    stays; of rows equal in both, that whose columns as JSON come first. A null
    doc_id stays only without others. Only rows with a near-duplicate, and a few
    by chance, are shuffled with their texts.
    """
    found = written(grouped(docs, radius, shingle, tile), "simhash-groups")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th")
    kept = written(found.groupBy("root").agg(F.min(place).alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-kept")
    one, two = fresh(docs, "rival_id"), fresh(docs, "rival_th")
    rivals = written(join_hot(found, kept, ["root"], "n").select(F.col("doc_id").alias(one), F.col("th").alias(two), F.col("kept").eqNullSafe(place).alias("stays")), "simhash-rivals")
    words = written(sieve(rivals.select(F.xxhash64(one, two).alias("hash"))), "simhash-sieve")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(one)) & (text_hash() == F.col(two))
    left = sifted(docs, row_key(), words).join(rivals.filter("not stays").select(one, two).distinct(), same, "left_anti")
    twice = rivals.filter("stays").groupBy(one, two).count().filter("count > 1").select(one, two)
    if not twice.isEmpty():
        # equal rows: only these are shuffled to keep one
        columns = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        chosen = left.join(twice, same, "left_semi").groupBy(F.col("doc_id").cast("long").alias("k"), text_hash().alias("h")).agg(F.min_by(columns, F.to_json(columns)).alias("row"))
        left = left.join(twice, same, "left_anti").unionByName(chosen.select("row.*"))
    return sifted(docs, row_key(), words, "left_anti").unionByName(left)
