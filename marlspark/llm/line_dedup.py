"""Line dedup: winnowing over line hashes.

Units are a text's lines that hold a word, compared with A-Z lower-cased and white
space collapsed. A window is a shortest run of consecutive lines with
``min_words`` words or more, taken forwards and backwards from every line. The
line with the least hash in it (the rightmost of equals) is its fingerprint, and
windows next to each other mostly select the same one: what is kept of a text are
its distinct fingerprints with their positions. Any run of ``min_words`` words or
more is a union of windows that lie inside it, so two equal runs share the
fingerprints of all of these.

Positions are joined on the fingerprint's hash: one that stands nowhere else ends
here. Where others have the same, the match is extended both ways, to the left
and to the right over the lines of each window around it; it holds where the
lines on either side are equal too, and matches that touch grow together into the
maximal repeated run. All lines of a repeated run are deleted but for its first
occurrence, in the order of doc_id and line. The occurrences of a fingerprint are
dealt out by what surrounds it, so that a line that stands in very many texts is
no group of one task; those of a passage that does are aggregated before they are
shuffled and then stay where they are. No pairs of occurrences are formed.

Defined cases: null and empty texts have no lines and stay as they are. Lines
without a word are kept. Within one text, a run that overlaps its own first
occurrence is not a repetition of it. Rows of equal doc_id and equal text count
as one document: none of them is the later one. A null doc_id comes first in the
order. An empty table gives no rows. Other columns pass through untouched,
whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, fresh, join_hot, row_key, sieve, sifted, text_hash, utf8, written

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lines_of(text: bytes) -> tuple[list[int], list[bytes], list[int]]:
    """Of the lines that hold a word: line number, hash (8 bytes), number of words."""
    places, hashes, sizes = [], [], []
    for i, line in enumerate(text.translate(_LOWER).split(b"\n")):
        if words := line.split():
            places.append(i)
            hashes.append(xxhash.xxh3_64_digest(b" ".join(words)))
            sizes.append(len(words))
    return places, hashes, sizes


def windows(hashes: list[bytes], sizes: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """(fingerprint's line, first, last) of each window, by index among the lines with words."""
    out, n = set(), len(sizes)
    ends = np.cumsum(sizes) if n else np.zeros(0, np.int64)
    if not n or ends[-1] < min_words:
        return []
    before = ends - sizes
    # forwards: the first line by whose end min_words are reached; backwards: the last line from whose start they are
    to = np.searchsorted(ends, before + min_words)
    since = np.searchsorted(before, ends - min_words, side="right") - 1
    for i, j in [*((i, j) for i, j in enumerate(to.tolist()) if j < n), *((i, j) for j, i in enumerate(since.tolist()) if i >= 0)]:
        out.add((i, j))
    return [(i if i == j else min(range(j, i - 1, -1), key=hashes.__getitem__), i, j) for i, j in sorted(out)]


def fingerprints(hashes: list[bytes], sizes: list[int], min_words: int) -> dict[int, list[tuple[int, int, int]]]:
    """For each selected line, by index: (hash of the lines to its left and to its right, first, last) of the windows that select it."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    for f, i, j in windows(hashes, sizes, min_words):
        around = xxhash.xxh3_64_intdigest(b"".join(hashes[i:f]) + b"".join(hashes[f + 1 : j + 1]), seed=f - i)
        out.setdefault(f, []).append((around - (1 << 63), i, j))
    return out


def _positions(docs: DataFrame, min_words: int) -> DataFrame:
    names = ["doc_id", "th", "print", "around", "first", "last"]

    def batch(rows: pa.RecordBatch) -> dict:
        out: list[list] = [[] for _ in names]
        for doc_id, th, text in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "th", "text")), strict=True):
            places, hashes, sizes = lines_of(text)
            for f, found in fingerprints(hashes, sizes, min_words).items():
                row = doc_id, th, int.from_bytes(hashes[f], "big", signed=True), [x for x, _, _ in found], [places[i] for _, i, _ in found], [places[j] for _, _, j in found]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        return dict(zip(names, out, strict=True))

    return by_batch(docs.select("doc_id", "th", utf8("text")), batch, "doc_id long, th long, print long, around array<long>, first array<int>, last array<int>")


def repeated(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Spans of later repetitions in ``docs(doc_id, th, text)``: doc_id, th, first, last (line numbers), and whose they are."""
    found = written(_positions(docs, min_words), "line-prints")
    # the positions that share a fingerprint with another
    shared = found.groupBy(F.col("print").alias("hash")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = sifted(found, F.col("print"), written(sieve(shared), "line-sieve"))
    # extended both ways
    met = met.select("doc_id", "th", "print", F.explode(F.arrays_zip("around", "first", "last")).alias("w")).select("doc_id", "th", "print", "w.around", "w.first", "w.last")
    key = ["print", "around"]
    place = F.struct("doc_id", "th", "first", "last")
    again = written(met.groupBy(*key).agg(F.min(place).alias("origin"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "line-origins")
    later = (~F.col("doc_id").eqNullSafe(F.col("origin.doc_id"))) | (F.col("th") != F.col("origin.th")) | (F.col("first") > F.col("origin.last"))
    # the occurrences of a frequent passage stay where they are
    return join_hot(met, again, key, "n").filter(later).select("doc_id", "th", "first", "last", F.col("origin.doc_id").alias("first_doc"))


def _clean(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Per text: the text without the lines of its spans, and the numbers of lines and deleted lines, and these as ranges."""
    out = []
    for text, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if text is None:
            out.append((None, 0, 0, ""))
            continue
        lines, runs = text.split("\n"), []
        for s in sorted(found or (), key=lambda s: (s["first"], s["last"])):
            if runs and s["first"] <= runs[-1][1] + 1:
                runs[-1][1] = max(runs[-1][1], s["last"])
            else:
                runs.append([s["first"], s["last"]])
        gone = [[i for i in range(a, b + 1) if lines[i].strip(" \t\r\x0b\x0c")] for a, b in runs]
        drop = {i for run in gone for i in run}
        out.append(("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text, len(lines), len(drop), ",".join(f"{a}-{b}" for a, b in runs)))
    kinds = [("text", pa.string()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.string())]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=[n for n, _ in kinds])


def dedup(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs(doc_id, text, ...)`` with the later repeated runs deleted from text, and a struct column ``line_dedup``.

    ``line_dedup`` (with underscores added if ``docs`` has such a column) has
    n_lines and n_removed, and removed: the runs of lines as ``first-last,...`` by
    line number in the old text. All rows stay. Only the texts with a run to
    delete, and a few by chance, are shuffled.
    """
    spans = repeated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), "text"), min_words)
    report, found = fresh(docs, "line_dedup"), fresh(docs, "line_spans")
    spans = written(spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "line-spans").select(F.struct("doc_id", "th", "spans").alias(found))
    words = written(sieve(spans.select(F.xxhash64(f"{found}.doc_id", f"{found}.th").alias("hash"))), "line-sieve")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{found}.doc_id")) & (text_hash() == F.col(f"{found}.th"))
    clean = F.arrow_udf(_clean, "text string, n_lines long, n_removed long, removed string")
    hit = sifted(docs, row_key(), words).join(spans, same, "left").withColumn(report, clean("text", f"{found}.spans"))
    hit = hit.withColumn("text", F.col(f"{report}.text")).withColumn(report, F.col(report).dropFields("text")).drop(found)
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    rest = sifted(docs, row_key(), words, "left_anti").withColumn(report, F.struct(lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("removed")))
    return hit.unionByName(rest)


def sql(min_words: int = 50) -> str:
    """The query op5 for DuckDB over ``documents``, with the windows' very texts in place of hashes.

    Without fingerprints: these only say which windows are compared, not the result.
    """
    space = "[\\x20\\x09-\\x0D]"
    upper = "".join(map(chr, range(65, 91)))
    return f"""
with d as (select doc_id, text, string_split(text, chr(10)) raw from documents),
l as (select doc_id, pos, trim(regexp_replace(translate(x, '{upper}', '{upper.lower()}'), '{space}+', ' ', 'g')) line from (select doc_id, unnest(raw) x, unnest(range(len(raw))) pos from d)),
n as (select doc_id, pos, line, row_number() over (partition by doc_id order by pos) k, len(string_split(line, ' ')) size from l where line <> ''),
c as (select *, sum(size) over (partition by doc_id order by k) upto from n),
forward as (select a.doc_id, a.k i, min(b.k) j from c a join c b on a.doc_id = b.doc_id and b.k >= a.k and b.upto - a.upto + a.size >= {min_words} group by all),
backward as (select b.doc_id, max(a.k) i, b.k j from c a join c b on a.doc_id = b.doc_id and b.k >= a.k and b.upto - a.upto + a.size >= {min_words} group by all),
win as (select distinct doc_id, i, j from (from forward union all from backward)),
told as (select w.doc_id, i, j, min(pos) first, max(pos) last, string_agg(line, chr(10) order by k) content from win w join c on w.doc_id = c.doc_id and k between i and j group by w.doc_id, i, j),
origin as (select content, arg_min({{'d': doc_id, 'e': last}}, (doc_id, first)) o from told group by content),
span as (select doc_id, first, last from told join origin using (content) where doc_id <> o.d or first > o.e),
gone as (select distinct c.doc_id, pos from c join span s on c.doc_id = s.doc_id and pos between first and last),
edge as (select doc_id, first, last, max(last) over (partition by doc_id order by first, last rows between unbounded preceding and 1 preceding) before from (select distinct doc_id, first, last from span)),
runs as (select doc_id, grp, min(first) a, max(last) b from (select *, sum(case when before is null or first > before + 1 then 1 else 0 end) over (partition by doc_id order by first, last) grp from edge) group by doc_id, grp),
listed as (select doc_id, string_agg(a || '-' || b, ',' order by a) removed from runs group by doc_id),
g as (select doc_id, list(pos) ats, count(*) n from gone group by doc_id),
e as (select d.doc_id, case when text is null then 0 else len(raw) end::bigint n_lines, coalesce(n, 0)::bigint n_removed, coalesce(removed, '') removed, case when ats is null then text else coalesce(array_to_string(list_transform(list_filter(range(len(raw)), lambda q: not list_contains(ats, q)), lambda q: raw[q + 1]), chr(10)), '') end text from d left join g using (doc_id) left join listed using (doc_id))
select doc_id, n_lines, n_removed, removed, coalesce(length(text), 0)::bigint n_chars, text from e"""
