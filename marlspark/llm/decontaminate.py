"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become template tokens: numbers, units and names are
replaced by typed placeholders (slots), other words are lower-cased without
outer punctuation. Windows of ``width`` template tokens are hash-joined: the
texts' windows first pass a bitmap of the benchmark's windows, of fixed size, so
that only likely ones leave the scan. Candidate pairs come from each item's
rarest windows, just so many that no pair of the wanted similarity can miss them
all. A pair is verified at every place of the text that has windows enough: an
item slot must stand for one and the same value wherever it occurs there (two
may stand for the same), and windows that break this do not count. The best
place counts. The similarity is the share of the item's distinct windows that are left.

Defined cases: null and empty texts match nothing, as texts and as items; an item
of one word matches every text that has the word (``least_tokens`` leaves items of
fewer tokens out). Repeated rows of a text count as one; rows of one doc_id with
different texts are matched each on their own, and so are rows of one item_id. A
pair is reported once, at its best place, of the item's text that is found most
fully. Items of equal text are reported each. Empty tables on either side give no
rows. Further columns of any name do no harm.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SIEVE_BITS, by_batch, fresh, sieve, sifted, text_hash, utf8, written

WIDTH, SIMILARITY = 5, 0.8
#: A benchmark of so many windows at most (about 50 MB of them) is broadcast to the texts' windows; a larger one is joined by a shuffle.
BROADCAST_WINDOWS = 300_000
#: Fewer literal tokens than this in a window say too little.
LEAST_LITERALS = 3

# Number words and units.
NUMBER_WORDS = "zero two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds lb lbs ounce ounces ml litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees km/h mph".split()

NUMBER, UNIT, NAME = 1, 2, 3
_NUMBER = re.compile(rb"[+-]?[$\xe2\x82\xac]*\d+(?:[.,:/]\d+)*(?:st|nd|rd|th|%)?")
_OUTER = b".,;:!?\"'()[]{}*#$%&|<>`~_-"
_SLOT_CODES = {k: xxhash.xxh3_64_intdigest(b"slot %d" % k) for k in (NUMBER, UNIT, NAME)}
_UPPER = re.compile("[A-ZÀ-ÖØ-Þ]")


class Tokens(dict):
    """Numbers raw words; arrays have what is known of each: code of the literal, slot kind, capitalised, ends a sentence, value's hash."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most
        self._numbers, self._units = {x.encode() for x in NUMBER_WORDS}, {x.encode() for x in UNITS}
        self._grow(1 << 12)

    def _grow(self, size: int) -> None:
        for name, kind in (("code", np.uint64), ("kind", np.int8), ("capital", bool), ("ends", bool), ("value", np.uint64)):
            new, old = np.zeros(size, kind), getattr(self, name, None)
            if old is not None:
                new[: len(old)] = old
            setattr(self, name, new)

    def trim(self) -> None:
        """Between texts: forgets the words if there are too many."""
        if len(self) > self.most:
            self.clear()

    def __missing__(self, raw: bytes) -> int:
        bare = raw.strip(_OUTER)
        text = bare.decode(errors="replace")
        low = text.lower().encode()
        n = len(self)
        if n == len(self.code):
            self._grow(2 * n)
        self.code[n] = xxhash.xxh3_64_intdigest(low)
        self.kind[n] = NUMBER if _NUMBER.fullmatch(bare) or low in self._numbers else UNIT if low in self._units else 0
        # a name has a capital and goes on in small letters
        self.capital[n] = bool(_UPPER.match(text)) and text[1:].islower()
        self.ends[n] = raw.rstrip(b"\"')]*#$%&|<>").endswith((b".", b"!", b"?", b":"))
        self.value[n] = xxhash.xxh3_64_intdigest(low, 1)
        self[raw] = n
        return n


def template(text: bytes, memo: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each template token: its code, its slot kind (0: literal), and its value's hash."""
    memo.trim()
    numbers: list[int] = []
    starts: list[int] = []
    for line in text.split(b"\n"):
        starts.append(len(numbers))
        numbers += map(memo.__getitem__, line.split())
    at = np.array(numbers, np.int64)
    codes, kinds, values = memo.code[at], memo.kind[at], memo.value[at]
    first = np.zeros(len(at) + 1, bool)
    first[starts] = True
    first[1:] |= memo.ends[at]
    kinds[(kinds == 0) & memo.capital[at] & ~first[:-1]] = NAME
    for k, c in _SLOT_CODES.items():
        codes[kinds == k] = c
    return codes, kinds, values


def window_hashes(codes: np.ndarray, width: int, start: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` codes."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, start, np.uint64)
    for k in range(width):
        out = (out ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _literals(kinds: np.ndarray, width: int, n: int) -> np.ndarray:
    return sum((kinds[k : k + n] == 0).astype(np.int64) for k in range(width)) if n > 0 else np.zeros(0, np.int64)


def _slots(kinds: np.ndarray, values: np.ndarray, at: int, width: int) -> list[int]:
    """kind << 60 | value's low 60 bits, of the slots of a window, in order (as signed longs)."""
    return [int(np.int64((int(kinds[i]) << 60 | int(values[i]) & (1 << 60) - 1))) for i in range(at, at + width) if kinds[i]]


def windows_of(codes: np.ndarray, kinds: np.ndarray, values: np.ndarray, width: int, by_values: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Of each window: its hash, as a template if it has literals enough and else by its values, and whether it has.

    Without ``by_values`` the latter have no hash.
    """
    rich = _literals(kinds, width, len(codes) - width + 1) >= min(width, LEAST_LITERALS)
    hashes = window_hashes(codes, width, width)
    return np.where(rich, hashes, window_hashes(values, width, ~width & 0xFFFF)) if by_values and not rich.all() else hashes, rich


def _found(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)


def item_windows(benchmark: DataFrame, width: int = WIDTH, least_tokens: int = 1) -> DataFrame:
    """item_id, ih (a hash of the item's text), width, by_values, at, hash, slots of the windows that ``benchmark(item_id, text)`` is looked for by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Tokens()
        for batch in batches:
            out = []
            for item, ih, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                codes, kinds, values = template(text, memo)
                if (own := min(width, len(codes))) < 1 or len(codes) < least_tokens:
                    continue
                hashes, rich = windows_of(codes, kinds, values, own)
                for at in np.flatnonzero(rich if rich.any() else ~rich).tolist():
                    out.append((item, ih, own, not rich[at], at, int(hashes[at].view(np.int64)), _slots(kinds, values, at, own) if rich[at] else []))
            yield _found(out, ["item_id", "ih", "width", "by_values", "at", "hash", "slots"], [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.list_(pa.int64())])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_hash().alias("ih"), utf8("text")).distinct()
    return rows.mapInArrow(run, "item_id long, ih long, width int, by_values boolean, at int, hash long, slots array<bigint>")


def bitmap(windows: DataFrame, bits: int = SIEVE_BITS) -> np.ndarray:
    """The windows' hashes as a bitmap of 2**bits bits; at most 2**(bits - 6) small rows come to the driver."""
    found = sieve(windows, bits).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return out


def _passes(map_: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    place = hashes >> np.uint64(64 - bits)
    return (map_[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def text_windows(docs: DataFrame, map_: np.ndarray, widths: list[tuple[int, bool]], bits: int = SIEVE_BITS) -> DataFrame:
    """Per text of ``docs(doc_id, text)`` with windows in the bitmap: doc_id, th (the text's hash) and these windows.

    ``widths`` has the widths that items have, and whether windows of that width are looked for by their values too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(map_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, known = Tokens(), shared.value
        kind = pa.list_(pa.struct([("at", pa.int32()), ("hash", pa.int64()), ("slots", pa.list_(pa.int64()))]))
        for batch in batches:
            out = []
            for doc_id, th, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                codes, kinds, values = template(text, memo)
                windows = []
                for width, by_values in widths:
                    hashes, rich = windows_of(codes, kinds, values, width, by_values)
                    hits = _passes(known, hashes, bits)
                    for at in np.flatnonzero(hits if by_values else hits & rich).tolist():
                        windows.append({"at": at, "hash": int(hashes[at].view(np.int64)), "slots": _slots(kinds, values, at, width) if rich[at] else []})
                if windows:
                    out.append((doc_id, th, windows))
            yield _found(out, ["doc_id", "th", "windows"], [pa.int64(), pa.int64(), kind])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), utf8("text"))
    return rows.mapInArrow(run, "doc_id long, th long, windows array<struct<at: int, hash: bigint, slots: array<bigint>>>")


def _consistent(chosen: list[tuple], places: dict[int, list[dict]], once: bool) -> list[tuple[int, int]]:
    """(place, hash) of the windows of a stretch that agree on what each value of the item stands for: what most windows say, and with ``once`` each for another value."""
    shifts = Counter(at - w["at"] for at, h, _ in chosen for w in places[h])
    shift = max(shifts, key=lambda x: (shifts[x], -x))
    votes: dict[int, Counter] = defaultdict(Counter)
    for at, h, slots in chosen:
        for w in places[h]:
            for a, b in zip(w["slots"], slots, strict=False):
                # of equal counts, the values that stand where the item has them
                votes[a][b] += (1 << 20) + (at - w["at"] == shift)
    stands, taken = {}, set()
    for a, counter in sorted(votes.items(), key=lambda v: (-max(v[1].values()), v[0])):
        for b, _ in sorted(counter.items(), key=lambda x: (-x[1], x[0])):
            if not once or b not in taken:
                stands[a] = b
                taken.add(b)
                break
    return [(at, h) for at, h, slots in chosen if any(len(w["slots"]) == len(slots) and all(stands.get(a) == b for a, b in zip(w["slots"], slots, strict=True)) for w in places[h])]


def best_place(item: list[dict], text: list[dict], width: int, least: int = 1) -> tuple[int, int, int]:
    """(number of distinct item windows found consistently, first and last word) at the text's best place; stretches of under ``least`` windows are not looked at."""
    places = defaultdict(list)
    for w in item:
        places[w["hash"]].append(w)
    hits = sorted((w["at"], w["hash"], w["slots"]) for w in text if w["hash"] in places)
    ats = [w["at"] for w in item]
    best, tried = (0, 0, 0), set()
    # stretches of the text just as long as the item, where what stands beside a copy has no say, then as long and half of it
    for reach in (max(ats) - min(ats) + width, (max(ats) + width) * 3 // 2):
        lo, inside = 0, Counter()
        for hi, (at, h, _) in enumerate(hits):
            inside[h] += 1
            while at + width - hits[lo][0] > reach:
                inside[hits[lo][1]] -= 1
                if not inside[hits[lo][1]]:
                    del inside[hits[lo][1]]
                lo += 1
            if len(inside) < least or len(inside) <= best[0] or (lo, hi) in tried:
                continue
            tried.add((lo, hi))
            for once in (True, False):
                kept = _consistent(hits[lo : hi + 1], places, once)
                if (n := len({h for _, h in kept})) > best[0]:
                    best = (n, min(at for at, _ in kept), max(at for at, _ in kept) + width - 1)
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, least_tokens: int = 1) -> DataFrame:
    """Pairs of ``docs(doc_id, text)`` and ``benchmark(item_id, text)`` that match.

    Columns: doc_id, item_id, n_windows (distinct, of the item), n_found,
    similarity, first_word, last_word (of the place in the text).
    """
    items = written(item_windows(benchmark, width, least_tokens), "benchmark-windows")
    # one row for each width, 1 to ``width``
    widths = sorted((r.width, r.by_values) for r in items.groupBy("width").agg(F.bool_or("by_values").alias("by_values")).collect())
    texts = written(text_windows(docs, bitmap(items), widths).distinct(), "text-windows")
    # each item's windows with its distinct hashes in the order of rarity
    name = ["item_id", "ih"]
    spread = items.groupBy("hash").agg(F.countDistinct(*(F.coalesce(F.col(c), F.lit(0)) for c in name)).alias("df"))
    ranked = F.array_sort(F.collect_set(F.struct("df", "hash")))
    grouped = items.join(spread, "hash").groupBy(*name, "width").agg(F.collect_list(F.struct("at", "hash", "slots")).alias("item"), ranked.alias("ranked"))
    # without all of the rarest n - ceil(similarity * n) + 1 the similarity cannot be reached
    n = F.size("ranked")
    grouped = grouped.withColumn("probe", F.expr(f"slice(ranked, 1, size(ranked) - cast(ceil({similarity} * size(ranked) - 1e-9) as int) + 1)")).withColumn("n_windows", n.cast("long"))
    grouped = written(grouped.withColumn("item_key", F.xxhash64(*name)), "benchmark-items")
    near = F.broadcast if items.count() <= BROADCAST_WINDOWS else lambda x: x  # so a frequent window's texts need no shuffle
    probes = near(grouped.select("item_id", "ih", "item_key", F.explode("probe.hash").alias("hash")))
    seen = texts.select("doc_id", "th", F.explode(F.array_distinct("windows.hash")).alias("hash"))
    pairs = seen.join(probes, "hash").select("doc_id", "th", *name, "item_key").distinct()
    its = near(grouped.select(*(F.col(c).alias(f"i_{c}") for c in (*name, "item_key")), "width", "item", "ranked", "n_windows"))
    pairs = pairs.join(its, (F.col("item_key") == F.col("i_item_key")) & F.col("item_id").eqNullSafe(F.col("i_item_id")) & (F.col("ih") == F.col("i_ih"))).select(pairs["doc_id"].alias("d"), pairs["th"].alias("h"), "item_id", "width", "item", "ranked.hash", "n_windows")
    # of a text only the windows that the item has
    own = F.filter("windows", lambda w: F.array_contains("hash", w["hash"]))
    both = texts.join(pairs, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))).select("doc_id", "item_id", "n_windows", "width", "item", own.alias("windows"))

    def verify(rows: pa.RecordBatch) -> dict:
        found = [best_place(i, t, w, math.ceil(similarity * n - 1e-9)) for i, t, n, w in zip(*(rows.column(c).to_pylist() for c in ("item", "windows", "n_windows", "width")), strict=True)]
        columns = {c: rows.column(c) for c in ("doc_id", "item_id", "n_windows")}
        return columns | {c: [f[i] for f in found] for i, c in enumerate(("n_found", "first_word", "last_word"))}

    checked = by_batch(both, verify, "doc_id long, item_id long, n_windows long, n_found long, first_word long, last_word long")
    checked = checked.withColumn("similarity", F.col("n_found") / F.col("n_windows")).filter(F.col("similarity") >= similarity - 1e-9)
    # rows of one doc_id or item_id with different texts: the best of them
    best = F.max_by(F.struct("n_windows", "n_found", "similarity", "first_word", "last_word"), F.struct("similarity", "n_found", -F.col("first_word"), -F.col("last_word"))).alias("b")
    return checked.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.n_windows", "b.n_found", "b.similarity", "b.first_word", "b.last_word")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows whose doc_id matches an item. Rows with a null doc_id are dropped if any such text matches.

    Only texts that match, and a few by chance, are shuffled.
    """
    leaked, key = fresh(docs, "leaked_id"), F.xxhash64(F.col("doc_id").cast("long"))
    found = written(leaks(docs, benchmark, width, similarity).select(F.col("doc_id").alias(leaked)).distinct(), "leaked-ids")
    words = written(sieve(found.select(F.xxhash64(leaked).alias("hash"))), "leaked-sieve")
    rest = sifted(docs, key, words).join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(leaked)), "left_anti")
    return sifted(docs, key, words, "left_anti").unionByName(rest)
