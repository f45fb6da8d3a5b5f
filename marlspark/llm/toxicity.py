"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding: homoglyphs and full-width forms become Latin letters, A-Z becomes lower
case, and digits and signs that stand for letters become these. Entries are
whole words, or beginnings of words, with a weight; a match inside an exception
phrase does not count. A text's sum of weights, as it is and divided by the
logarithm of its number of words, goes through a logistic curve.

The lexicon is learned from labelled documents: words and beginnings of words
that are more frequent in toxic ones are candidates, copies of a text counting
once; their weights, none below zero, are those of a penalised logistic
regression, and candidates of next to no weight are left out. Exception phrases
are learned too: two words next to each other, one of them in the lexicon, that
stand together in documents that are not toxic, and hardly in toxic ones.

Defined cases: null and empty texts match nothing and get the score of a text
without matches. Repeated rows are scored each on their own. Without labels of
both classes the lexicon is ``SEEDS``, with fixed weights. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, id_crc, id_crc_column, labelled_sample, scoped, utf8

#: Bound on what is learned from: documents of each label.
TRAIN_DOCS = 2500
THRESHOLD = 0.7
#: An exception phrase stands in so many documents that are not toxic, at least, and is so many times as frequent there.
LEAST_PHRASE, PHRASE_RATIO = 3, 5

# Used where nothing can be learned.
SEEDS = ["idiot", "moron", "stupid", "loser", "scum", "worthless", "pathetic", "disgusting", "trash", "clown"]
# Phrases in which a lexicon word means no harm.
EXCEPTIONS = ["clown fish", "circus clown", "trash can", "trash bin", "trash bag", "idiot proof", "sore loser", "scum line", "pond scum", "soap scum"]
# Look-alikes, as letter and the characters that stand for it.
HOMOGLYPHS = {"a": "аαɑ", "b": "Ьβ", "c": "сϲ", "d": "ԁ", "e": "еєε", "g": "ɡ", "h": "һ", "i": "іιı", "j": "ј", "k": "кκ", "l": "ӏ", "m": "м", "n": "п", "o": "оοσ", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "тτ", "u": "υ", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγ"}
# Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

_GLYPHS = {ord(c): k for k, v in HOMOGLYPHS.items() for c in v} | {ord(c.upper()): k for k, v in HOMOGLYPHS.items() for c in v if len(c.upper()) == 1 and ord(c.upper()) > 127} | {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {0xFF10 + i: chr(48 + i) for i in range(10)}
_HAS_GLYPH = re.compile("[" + "".join(map(re.escape, map(chr, sorted(_GLYPHS)))) + "]")
_MAY_HAVE = re.compile(rb"[\xc4\xc9\xce-\xd4\xef]")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LEET = bytes(ord(DIGITS.get(chr(c), chr(c))) if c < 128 else c for c in range(256))
_ACCENTED = re.compile(rb"\xc3[\x80-\x96\x98-\x9e]")
_WORD = re.compile(rb"[a-z0-9@$\x80-\xff]+")
_LETTER = frozenset([*b"abcdefghijklmnopqrstuvwxyz", *range(128, 256)])
_LETTERS, _LETTERS_BACK = re.compile(rb"[a-z\x80-\xff]{1,64}(?![a-z\x80-\xff])"), re.compile(rb"(?<![a-z0-9\x80-\xff])[a-z\x80-\xff]{1,64}$")
_INNER = _LETTER | frozenset(b"0123456789")


def folded(text: bytes) -> tuple[bytes, bytes]:
    """The text with look-alikes and case folded, and the same, of equal length, with digits folded too."""
    if _MAY_HAVE.search(text) and _HAS_GLYPH.search(s := text.decode()):
        text = s.translate(_GLYPHS).encode()
    low = _ACCENTED.sub(lambda m: bytes((0xC3, m[0][1] + 32)), text.translate(_LOWER))
    return low, low.translate(_LEET)


def units(text: bytes) -> Counter:
    """Lexicon candidates of a text, counted: ``word``, and ``beginning*`` (4 to 9 characters of longer words)."""
    out: Counter = Counter()
    for raw, n in Counter(_WORD.findall(folded(text)[0])).items():
        word = raw.rstrip(b"0123456789@$").lstrip(b"@$").translate(_LEET).decode(errors="replace")
        if 3 <= len(word) <= 24:
            out[word] += n
        for k in range(4, min(10, len(word))):
            out[f"{word[:k]}*"] += n
    return out


def dose(count: int) -> float:
    """What an entry's weight is multiplied by: each further match of it adds less."""
    return math.sqrt(count)


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: list[str]
    curve: list[float] = field(default_factory=lambda: [-3.0, 1.0, 1.0])
    built: object = None

    def automaton(self) -> ahocorasick.Automaton:
        """Entries as UTF-8 bytes read as Latin-1, one character a byte."""
        if self.built is None:
            kinds: dict[str, list] = {}
            for unit in self.weights:
                kinds.setdefault(unit.rstrip("*").encode().decode("latin-1"), [None, None, False])[unit.endswith("*")] = unit
            for phrase in self.exceptions:
                kinds.setdefault(phrase.encode().translate(_LEET).decode("latin-1"), [None, None, False])[2] = True
            self.built = ahocorasick.Automaton()
            for key, kind in kinds.items():
                self.built.add_word(key, (len(key), *kind))
            self.built.make_automaton()
        return self.built

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "built": None}

    def found(self, text: bytes) -> tuple[list[tuple[int, int, str]], bytes]:
        """(first, last, entry) of each match, those in exception phrases left out, and the folded text they refer to."""
        low, flat = folded(text)
        if not self.weights:
            return [], flat
        found, safe, n = [], [], len(low)
        for last, (size, whole, start, exempt) in self.automaton().iter(flat.decode("latin-1")):
            first = last - size + 1
            if first and low[first - 1] in _INNER:
                continue
            more = last + 1 < n and flat[last + 1] in _LETTER
            if not (last + 1 < n and low[last + 1] in _LETTER):
                if exempt:
                    safe.append((first, last))
                if whole:
                    found.append((first, last, whole))
            if more and start:
                found.append((first, last, start))
        if safe:
            # the furthest end of the phrases that begin at a place or before it
            safe.sort()
            begins, ends = [a for a, _ in safe], list(itertools.accumulate((b for _, b in safe), max))
            found = [f for f in found if not (k := bisect.bisect_right(begins, f[0])) or ends[k - 1] < f[1]]
        return found, flat

    def total(self, text: bytes) -> tuple[float, int]:
        """The weighted sum over the text's entries, and the number of matched words."""
        found, _ = self.found(text)
        counts = Counter(unit for _, _, unit in found)
        return sum(self.weights[u] * dose(c) for u, c in counts.items()), len({first for first, _, _ in found})

    def phrases(self, text: bytes) -> set[str]:
        """Each matched word with the word before it and with the word after it, where a single space is between them."""
        found, flat = self.found(text)
        out = set()
        for first, last, _ in found:
            end = last + 1
            while end < len(flat) and flat[end] in _LETTER:
                end += 1
            if flat[end : end + 1] == b" " and (m := _LETTERS.match(flat, end + 1)):
                out.add(flat[first : m.end()])
            if first and flat[first - 1] == 32 and (m := _LETTERS_BACK.search(flat[max(0, first - 65) : first - 1])):
                out.add(m[0] + b" " + flat[first:end])
        return {p.decode(errors="replace") for p in out}

    def inputs(self, text: bytes) -> tuple[float, float, int]:
        weight, n = self.total(text)
        return weight, weight / max(1.0, math.log1p(len(text.split()))), n

    def score(self, text: bytes) -> tuple[float, int]:
        x, y, n = self.inputs(text)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.curve[0] + self.curve[1] * x + self.curve[2] * y)))), n


def learned(candidates: list[str], counts: list[dict[str, int]], y: np.ndarray, penalty: float = 1e-3, steps: int = 200) -> dict[str, float]:
    """Weights of the candidates, by logistic regression with none below zero; both classes weigh the same."""
    column = {u: i for i, u in enumerate(candidates)}
    rows = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
    at = np.array([column[u] for c in counts for u in c], np.int64)
    dosed = np.array([dose(n) for c in counts for n in c.values()])
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    (w, m, v), shift = (np.zeros(len(candidates)) for _ in range(3)), 0.0
    for k in range(1, steps + 1):
        sums = np.bincount(rows, dosed * w[at], len(counts))
        e = share * (1 / (1 + np.exp(-np.clip(sums + shift, -30, 30))) - y)
        g = np.bincount(at, dosed * e[rows], len(candidates)) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = np.maximum(w - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8), 0)
        shift -= 2 * float(e.sum())
    return {u: float(w[i]) for u, i in column.items() if w[i] > 0.02}


def curve(x: np.ndarray, y: np.ndarray, steps: int = 3000) -> list[float]:
    """Logistic regression of y on the two inputs, by plain gradient steps with a small penalty."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        w -= 0.5 * (a.T @ (weight * (p - y)) + 1e-3 * w)
    return w.tolist()


@scoped
def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Lexicon:
    """Learns from ``labels(doc_id, toxic)`` of documents outside the held-out third, ``train_docs`` of each label at most.

    The driver gets the candidates, how often each sampled document has them, the
    exception phrases, and two inputs a document: all bounded by the sample.
    """
    sample = labelled_sample(docs, labels, "toxic", id_crc_column() % 3 != 1, train_docs, "toxicity-sample").select("y", utf8("text"))
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_clean or not n_toxic:
        return Lexicon({w: 3.0 for w in SEEDS}, EXCEPTIONS)

    def counted(rows: pa.RecordBatch) -> dict:
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for y, text in zip(rows.column("y").to_pylist(), rows.column("text").to_pylist(), strict=True):
            counts[y].update(units(text).keys())
        every = sorted(counts[0].keys() | counts[1].keys())
        return {"unit": every, "toxic": [counts[1][u] for u in every], "clean": [counts[0][u] for u in every]}

    once = sample.withColumn("th", F.xxhash64("text")).dropDuplicates(["th", "y"]).select("y", "text")
    tally = by_batch(once, counted, "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    apart = F.col("toxic") / n_toxic >= 5 * (F.col("clean") + 0.5) / n_clean
    few = tally.filter((F.col("toxic") >= max(3, 0.002 * n_toxic)) & apart).select("unit").collect()
    candidates = sorted(r["unit"] for r in few)
    wanted = frozenset(candidates)

    def covered(rows: pa.RecordBatch) -> dict:
        found = [{u: n for u, n in units(t).items() if u in wanted} for t in rows.column("text").to_pylist()]
        return {"y": rows.column("y"), "units": [list(f) for f in found], "counts": [list(f.values()) for f in found]}

    # the sample is bounded; put in order here, so that sums do not hang on how rows arrive
    rows = by_batch(sample, covered, "y int, units array<string>, counts array<int>").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["y"], sorted(zip(r["units"], r["counts"], strict=True))))
    counts = [dict(zip(r["units"], r["counts"], strict=True)) for r in rows]
    weights = learned(candidates, counts, np.array([r["y"] for r in rows]))
    bare = Lexicon(weights, [])

    def around(rows: pa.RecordBatch) -> dict:
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for y, text in zip(rows.column("y").to_pylist(), rows.column("text").to_pylist(), strict=True):
            counts[y].update(bare.phrases(text))
        every = sorted(counts[0].keys() | counts[1].keys())
        return {"phrase": every, "toxic": [counts[1][p] for p in every], "clean": [counts[0][p] for p in every]}

    met = by_batch(once, around, "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    harmless = (F.col("clean") >= LEAST_PHRASE) & (F.col("clean") / n_clean >= PHRASE_RATIO * F.col("toxic") / n_toxic)
    lexicon = Lexicon(weights, sorted(r["phrase"] for r in met.filter(harmless).select("phrase").collect()))

    def inputs(rows: pa.RecordBatch) -> dict:
        found = [lexicon.inputs(t) for t in rows.column("text").to_pylist()]
        return {"y": rows.column("y"), "x": [f[0] for f in found], "z": [f[1] for f in found]}

    got = by_batch(sample, inputs, "y int, x double, z double").toArrow()
    y, x, z = (got.column(c).to_numpy() for c in ("y", "x", "z"))
    order = np.lexsort((z, x, y))
    lexicon.curve = curve(np.column_stack([x, z])[order], y[order])
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, held_out, score, predicted, n_matches."""

    def batch(rows: pa.RecordBatch) -> dict:
        ids, found = rows.column("doc_id"), [lexicon.score(t) for t in rows.column("text").to_pylist()]
        return {"doc_id": ids, "held_out": [id_crc(i) % 3 == 1 for i in ids.to_pylist()], "score": [f[0] for f in found], "predicted": [int(f[0] >= threshold) for f in found], "n_matches": [f[1] for f in found]}

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text")), batch, "doc_id long, held_out boolean, score double, predicted int, n_matches int")
