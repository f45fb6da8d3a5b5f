"""Quality classifier: a linear-chain conditional random field over a text's lines.

Each line with a word gets binned features of its own and of the lines next to
it. The field labels every line bad or good; forward-backward gives each line's
marginal probability of good, and the length-weighted mean of these is the
document's quality, which a logistic curve turns into the probability of label 1.

Only documents are labelled, so lines start with their document's label; lines of
bad documents that a plain logistic model of the same features finds good are
relabelled before the field is trained.

Defined cases: a text without a word (null and empty ones too) has score 0.
Repeated rows are scored each on their own. With labels of one class only, or
none, every text with a word gets the share of label 1 (none: 0.5). An empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, fresh, id_crc, id_crc_column, labelled_sample, scoped, utf8, written

#: Bounds on what is learned from: documents of each label, and lines in all.
TRAIN_DOCS, TRAIN_LINES = 2000, 200_000
#: Bytes of text that a worker takes apart at once; a longer text is taken alone.
SLICE = 1 << 20
THRESHOLD = 0.3

_SYMBOL, _UPPER, _LETTER, _DIGIT = b"#*$%&|<>!~^=_{}[]@\\", bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)]), b"0123456789"
_RATIO = (0.02, 0.06, 0.12, 0.25)
_SIZE = (2, 4, 8, 16, 64)
_LENGTH = (3, 4.5, 6, 9)
_DISTINCT = (0.2, 0.4, 0.6, 0.8)
#: Number of values of each own feature: symbols, capitals, digits, distinct words, words, word length, end, seen before.
_BINS = (5, 5, 5, 5, 6, 5, 2, 2)
#: Own features that a line also has of each neighbour; one more value stands for no neighbour.
_NEAR = (0, 1, 3, 7)


def _bin(x: float, edges: tuple) -> int:
    return sum(x >= e for e in edges)


def line_features(text: bytes) -> tuple[list[tuple[int, ...]], list[int]]:
    """The own features of each line with a word, and its length in bytes."""
    rows, sizes, seen = [], [], set()
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        size, n = len(line), len(words)
        solid = max(1, size - n + 1)
        letters = size - len(line.translate(None, _LETTER))
        upper = size - len(line.translate(None, _UPPER))
        rows.append((
            _bin((size - len(line.translate(None, _SYMBOL))) / solid, _RATIO),
            _bin(upper / letters if letters else 0.0, (0.1, 0.25, 0.5, 0.8)),
            _bin((size - len(line.translate(None, _DIGIT))) / solid, _RATIO),
            _bin(len(set(words)) / n if n > 3 else 1.0, _DISTINCT),
            _bin(n, _SIZE),
            _bin(solid / n, _LENGTH),
            int(words[-1].endswith((b".", b"?", b"!", b":", b";"))),
            int(line in seen),
        ))
        sizes.append(size)
        seen.add(line)
    return rows, sizes


_OWN = np.concatenate([[0], np.cumsum(_BINS)])[:-1]
_WIDTHS = [_BINS[k] + 1 for k in _NEAR]
_BEFORE = sum(_BINS) + np.concatenate([[0], np.cumsum(_WIDTHS)])[:-1]
_AFTER = _BEFORE + sum(_WIDTHS)
N_FEATURES = int(sum(_BINS) + 2 * sum(_WIDTHS))


def indices(own: np.ndarray, starts: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """(lines, features) active feature numbers of the lines from ``lo`` to before ``hi``; ``starts``: where each document's lines begin."""
    n = len(own)
    hi = n if hi is None else min(hi, n)
    at = np.arange(lo, hi)
    first = np.zeros(n + 1, bool)
    first[starts[starts < n]] = first[n] = True
    near = own[:, _NEAR]
    none = np.array([_BINS[k] for k in _NEAR])
    before = np.where(first[at][:, None], none, near[at - 1])
    after = np.where(first[at + 1][:, None], none, near[np.minimum(at + 1, n - 1)])
    return np.concatenate([own[at] + _OWN, before + _BEFORE, after + _AFTER], axis=1)


@dataclass
class Model:
    weights: np.ndarray  # towards good, by feature
    moves: np.ndarray  # 2 x 2, from label to label
    slope: float
    shift: float

    def score(self, quality: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * quality + self.shift, -50, 50)))


#: Lines, with the padding to a group's longest chain, that are worked on at once; a longer chain is a group of its own.
CELLS = 1 << 17


def _chains(sizes: np.ndarray) -> list[np.ndarray]:
    """Documents of like length together: groups of document numbers, with ``CELLS`` lines when padded, or a single one."""
    order, out, lo = np.argsort(sizes, kind="stable"), [], 0
    ordered = sizes[order].tolist()
    for hi, longest in enumerate(ordered):
        if hi > lo and (hi + 1 - lo) * longest > CELLS:
            out.append(order[lo:hi])
            lo = hi
    return [*out, order[lo:]] if len(order) else []


def forward_backward(emit: np.ndarray, starts: np.ndarray, sizes: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Per line the marginal probability of good; with ``pairs`` also the expected moves, 2 x 2, over all chains.

    Both passes keep, for each line, only by how much the logarithm for good is
    above that for bad: marginals need no more.
    """
    marginal, moved = np.zeros(len(emit)), np.zeros((2, 2))
    (m00, m01), (m10, m11) = moves.tolist()
    for group in _chains(sizes):
        n, longest = sizes[group], int(sizes[group].max(initial=0))
        if not longest:
            continue
        at = np.minimum(starts[group] + np.minimum(np.arange(longest)[:, None], np.maximum(n - 1, 0)), len(emit) - 1)
        x = emit[at]
        live = np.arange(longest)[:, None] < n
        before, after = x.copy(), np.zeros_like(x)
        for t in range(1, longest):
            p = before[t - 1]
            before[t] += np.logaddexp(m01, p + m11) - np.logaddexp(m00, p + m10)
        for t in range(longest - 2, -1, -1):
            q = after[t + 1] + x[t + 1]
            np.multiply(np.logaddexp(m10, q + m11) - np.logaddexp(m00, q + m01), live[t + 1], out=after[t])
        good = 1 / (1 + np.exp(-np.clip(before + after, -700, 700)))
        marginal[at[live]] = good[live]
        if pairs and longest > 1:
            q = after[1:] + x[1:]
            each = np.stack([np.full_like(q, m00), m01 + q, before[:-1] + m10, before[:-1] + m11 + q])
            each = np.exp(each - each.max(axis=0))
            moved += (each / each.sum(axis=0))[:, live[1:]].sum(axis=1).reshape(2, 2)
    return marginal, moved


def quality_of(marginal: np.ndarray, lengths: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals of each document; 0 without lines."""
    total = np.concatenate([[0], np.cumsum(marginal * lengths)])
    length = np.concatenate([[0], np.cumsum(lengths)])
    ends = starts + sizes
    return np.where(sizes > 0, (total[ends] - total[starts]) / np.maximum(length[ends] - length[starts], 1), 0.0)


def _adam(grad, size: int, steps: int, rate: float) -> np.ndarray:
    x, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for k in range(1, steps + 1):
        g = grad(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return x


def train(own: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, y: np.ndarray, steps: int = 80) -> Model:
    """The field from documents' labels ``y``; ``own`` and ``lengths`` by line, ``sizes``: lines of each document."""
    usable = sizes > 0
    if len(set(y[usable].tolist())) < 2:
        share = float(np.clip(y[usable].mean() if usable.any() else 0.5, 1e-3, 1 - 1e-3))
        return Model(np.zeros(N_FEATURES), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    active = indices(own, starts)
    of_doc = np.repeat(y, sizes).astype(float)
    # classes weigh the same
    balance = np.repeat(np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())), sizes) * len(y)
    penalty = 0.5

    def gather(per_line: np.ndarray) -> np.ndarray:
        return np.bincount(active.ravel(), np.repeat(per_line, active.shape[1]), N_FEATURES)

    def plain(w: np.ndarray) -> np.ndarray:
        return (gather(balance * (1 / (1 + np.exp(-np.clip(w[active].sum(1), -50, 50))) - of_doc)) + penalty * w) / len(of_doc)

    first = _adam(plain, N_FEATURES, steps, 0.1)
    lines = of_doc.copy()
    lines[(of_doc == 0) & (first[active].sum(1) > 2)] = 1
    inner = np.ones(len(lines), bool)
    inner[starts[usable]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (lines[:-1].astype(int)[inner[1:]], lines[1:].astype(int)[inner[1:]]), 1)

    def chain(p: np.ndarray) -> np.ndarray:
        w, moves = p[:N_FEATURES], p[N_FEATURES:].reshape(2, 2)
        marginal, moved = forward_backward(w[active].sum(1), starts, sizes, moves, pairs=True)
        return np.concatenate([gather(marginal - lines) + penalty * w, (moved - seen + penalty * moves).ravel()]) / len(lines)

    p = _adam(chain, N_FEATURES + 4, steps, 0.1)
    w, moves = p[:N_FEATURES], p[N_FEATURES:].reshape(2, 2)
    q = quality_of(forward_backward(w[active].sum(1), starts, sizes, moves)[0], lengths, starts, sizes)[usable]
    slope, shift, t = 1.0, 0.0, y[usable].astype(float)
    weight = np.where(t == 1, 0.5 / t.sum(), 0.5 / (1 - t).sum())
    for _ in range(400):  # logistic curve from quality to label, both classes weighing the same
        e = weight * (1 / (1 + np.exp(-np.clip(slope * q + shift, -50, 50))) - t)
        slope, shift = slope - 20 * ((e * q).sum() + 1e-4 * slope), shift - 20 * e.sum()
    return Model(w, moves, float(slope), float(shift))


def lines_each(counted: list[tuple[int, int]], total: int) -> int:
    """The most lines of each document, 1 at least, with which documents of ``counted`` (lines, documents) keep to ``total`` lines."""
    low, high = 1, max([1, *(size for size, _ in counted)])
    while low < high:
        middle = (low + high + 1) // 2
        if sum(min(size, middle) * n for size, n in counted) <= total:
            low = middle
        else:
            high = middle - 1
    return low


@scoped
def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> Model:
    """Learns from ``labels(doc_id, quality)`` of documents outside the held-out fifth.

    From at most ``train_docs`` documents of each label. If these have more than
    ``train_lines`` lines, from the first lines of each, as many as keep to it.
    """
    sample = labelled_sample(docs, labels, "quality", id_crc_column() % 5 != 0, train_docs, "quality-sample")

    def batch(rows: pa.RecordBatch) -> dict:
        found = [line_features(t) for t in rows.column("text").to_pylist()]
        flat = [np.array(r, np.int8).ravel().tobytes() for r, _ in found]
        return {"doc_id": rows.column("doc_id"), "y": rows.column("y"), "own": flat, "lengths": [s for _, s in found]}

    features = written(by_batch(sample.select("doc_id", "y", utf8("text")), batch, "doc_id long, y int, own binary, lengths array<long>"), "quality-features")
    counted = [(r.size, r.n) for r in features.groupBy(F.size("lengths").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()]
    most = lines_each(counted, train_lines)
    order = F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("own")
    cut = features.orderBy(*order).select("y", F.substring("own", 1, most * len(_BINS)).alias("own"), F.slice("lengths", 1, most).alias("lengths"))
    got = cut.toArrow()
    sizes = np.array([len(x) for x in got.column("lengths").to_pylist()], np.int64)
    own = np.frombuffer(b"".join(got.column("own").to_pylist()), np.int8).reshape(-1, len(_BINS)).astype(np.int64)
    lengths = np.array([x for row in got.column("lengths").to_pylist() for x in row], np.float64)
    return train(own, lengths, sizes, got.column("y").to_numpy())


def classify(texts: list[bytes], model: Model) -> tuple[np.ndarray, list[np.ndarray]]:
    """Scores of the texts, and each text's marginals of its lines with a word; about ``SLICE`` bytes of text are worked on at once."""
    scores, marginals, lo, size = [], [], 0, 0
    for hi, text in enumerate([*texts, None]):
        if text is None or size and size + len(text) > SLICE:
            if hi > lo:
                score, found = _classify(texts[lo:hi], model)
                scores.append(score)
                marginals += found
            lo, size = hi, 0
        size += len(text or b"")
    return np.concatenate([np.zeros(0), *scores]), marginals


def _classify(texts: list[bytes], model: Model) -> tuple[np.ndarray, list[np.ndarray]]:
    found = [line_features(t) for t in texts]
    sizes = np.array([len(s) for _, s in found], np.int64)
    starts = (np.cumsum(sizes) - sizes).astype(np.int64)
    rows = [r for own, _ in found for r in own]
    if not rows:
        return np.zeros(len(texts)), [np.zeros(0) for _ in texts]
    own, lengths = np.array(rows, np.int8), np.array([x for _, s in found for x in s], np.float64)
    emit, first = np.zeros(len(own)), starts[sizes > 0]
    for k in range(0, len(own), CELLS):
        emit[k : k + CELLS] = model.weights[indices(own, first, k, k + CELLS)].sum(1)
    marginal, _ = forward_backward(emit, starts, sizes, model.moves)
    score = np.where(sizes > 0, model.score(quality_of(marginal, lengths, starts, sizes)), 0.0)
    return score, [marginal[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def score(self, quality: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * quality + self.shift, -50, 50)))


#: Lines, with the padding to a group's longest chain, that are worked on at once; a longer chain is a group of its own.
CELLS = 1 << 17


def _chains(sizes: np.ndarray) -> list[np.ndarray]:
    """Documents of like length together: groups of document numbers, with ``CELLS`` lines when padded, or a single one."""
    order, out, lo = np.argsort(sizes, kind="stable"), [], 0
    ordered = sizes[order].tolist()
    for hi, longest in enumerate(ordered):
        if hi > lo and (hi + 1 - lo) * longest > CELLS:
            out.append(order[lo:hi])
            lo = hi
    return [*out, order[lo:]] if len(order) else []


def forward_backward(emit: np.ndarray, starts: np.ndarray, sizes: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Per line the marginal probability of good; with ``pairs`` also the expected moves, 2 x 2, over all chains.

    Both passes keep, for each line, only by how much the logarithm for good is
    above that for bad: marginals need no more.
    """
    marginal, moved = np.zeros(len(emit)), np.zeros((2, 2))
    (m00, m01), (m10, m11) = moves.tolist()
    for group in _chains(sizes):
        n, longest = sizes[group], int(sizes[group].max(initial=0))
        if not longest:
            continue
        at = np.minimum(starts[group] + np.minimum(np.arange(longest)[:, None], np.maximum(n - 1, 0)), len(emit) - 1)
        x = emit[at]
        live = np.arange(longest)[:, None] < n
        before, after = x.copy(), np.zeros_like(x)
        for t in range(1, longest):
            p = before[t - 1]
            before[t] += np.logaddexp(m01, p + m11) - np.logaddexp(m00, p + m10)
        for t in range(longest - 2, -1, -1):
            q = after[t + 1] + x[t + 1]
            np.multiply(np.logaddexp(m10, q + m11) - np.logaddexp(m00, q + m01), live[t + 1], out=after[t])
        good = 1 / (1 + np.exp(-np.clip(before + after, -700, 700)))
        marginal[at[live]] = good[live]
        if pairs and longest > 1:
            q = after[1:] + x[1:]
            each = np.stack([np.full_like(q, m00), m01 + q, before[:-1] + m10, before[:-1] + m11 + q])
            each = np.exp(each - each.max(axis=0))
            moved += (each / each.sum(axis=0))[:, live[1:]].sum(axis=1).reshape(2, 2)
    return marginal, moved


def quality_of(marginal: np.ndarray, lengths: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals of each document; 0 without lines."""
    total = np.concatenate([[0], np.cumsum(marginal * lengths)])
    length = np.concatenate([[0], np.cumsum(lengths)])
    ends = starts + sizes
    return np.where(sizes > 0, (total[ends] - total[starts]) / np.maximum(length[ends] - length[starts], 1), 0.0)


def _adam(grad, size: int, steps: int, rate: float) -> np.ndarray:
    x, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for k in range(1, steps + 1):
        g = grad(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return x


def train(own: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, y: np.ndarray, steps: int = 80) -> Model:
    """The field from documents' labels ``y``; ``own`` and ``lengths`` by line, ``sizes``: lines of each document."""
    usable = sizes > 0
    if len(set(y[usable].tolist())) < 2:
        share = float(np.clip(y[usable].mean() if usable.any() else 0.5, 1e-3, 1 - 1e-3))
        return Model(np.zeros(N_FEATURES), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    active = indices(own, starts)
    of_doc = np.repeat(y, sizes).astype(float)
    # classes weigh the same
    balance = np.repeat(np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())), sizes) * len(y)
    penalty = 0.5

    def gather(per_line: np.ndarray) -> np.ndarray:
        return np.bincount(active.ravel(), np.repeat(per_line, active.shape[1]), N_FEATURES)

    def plain(w: np.ndarray) -> np.ndarray:
        return (gather(balance * (1 / (1 + np.exp(-np.clip(w[active].sum(1), -50, 50))) - of_doc)) + penalty * w) / len(of_doc)

    first = _adam(plain, N_FEATURES, steps, 0.1)
    lines = of_doc.copy()
    lines[(of_doc == 0) & (first[active].sum(1) > 2)] = 1
    inner = np.ones(len(lines), bool)
    inner[starts[usable]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (lines[:-1].astype(int)[inner[1:]], lines[1:].astype(int)[inner[1:]]), 1)

    def chain(p: np.ndarray) -> np.ndarray:
        w, moves = p[:N_FEATURES], p[N_FEATURES:].reshape(2, 2)
        marginal, moved = forward_backward(w[active].sum(1), starts, sizes, moves, pairs=True)
        return np.concatenate([gather(marginal - lines) + penalty * w, (moved - seen + penalty * moves).ravel()]) / len(lines)

    p = _adam(chain, N_FEATURES + 4, steps, 0.1)
    w, moves = p[:N_FEATURES], p[N_FEATURES:].reshape(2, 2)
    q = quality_of(forward_backward(w[active].sum(1), starts, sizes, moves)[0], lengths, starts, sizes)[usable]
    slope, shift, t = 1.0, 0.0, y[usable].astype(float)
    weight = np.where(t == 1, 0.5 / t.sum(), 0.5 / (1 - t).sum())
    for _ in range(400):  # logistic curve from quality to label, both classes weighing the same
        e = weight * (1 / (1 + np.exp(-np.clip(slope * q + shift, -50, 50))) - t)
        slope, shift = slope - 20 * ((e * q).sum() + 1e-4 * slope), shift - 20 * e.sum()
    return Model(w, moves, float(slope), float(shift))


def lines_each(counted: list[tuple[int, int]], total: int) -> int:
    """The most lines of each document, 1 at least, with which documents of ``counted`` (lines, documents) keep to ``total`` lines."""
    low, high = 1, max([1, *(size for size, _ in counted)])
    while low < high:
        middle = (low + high + 1) // 2
        if sum(min(size, middle) * n for size, n in counted) <= total:
            low = middle
        else:
            high = middle - 1
    return low


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> Model:
    """Learns from ``labels(doc_id, quality)`` of documents outside the held-out fifth.

    From at most ``train_docs`` documents of each label. If these have more than
    ``train_lines`` lines, from the first lines of each, as many as keep to it.
    """
    sample = labelled_sample(docs, labels, "quality", id_crc_column() % 5 != 0, train_docs, "quality-sample")

    def batch(rows: pa.RecordBatch) -> dict:
        found = [line_features(t) for t in rows.column("text").to_pylist()]
        flat = [np.array(r, np.int8).ravel().tobytes() for r, _ in found]
        return {"doc_id": rows.column("doc_id"), "y": rows.column("y"), "own": flat, "lengths": [s for _, s in found]}

    features = written(by_batch(sample.select("doc_id", "y", utf8("text")), batch, "doc_id long, y int, own binary, lengths array<long>"), "quality-features")
    counted = [(r.size, r.n) for r in features.groupBy(F.size("lengths").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()]
    most = lines_each(counted, train_lines)
    order = F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("own")
    cut = features.orderBy(*order).select("y", F.substring("own", 1, most * len(_BINS)).alias("own"), F.slice("lengths", 1, most).alias("lengths"))
    got = cut.toArrow()
    sizes = np.array([len(x) for x in got.column("lengths").to_pylist()], np.int64)
    own = np.frombuffer(b"".join(got.column("own").to_pylist()), np.int8).reshape(-1, len(_BINS)).astype(np.int64)
    lengths = np.array([x for row in got.column("lengths").to_pylist() for x in row], np.float64)
    return train(own, lengths, sizes, got.column("y").to_numpy())


def classify(texts: list[bytes], model: Model) -> tuple[np.ndarray, list[np.ndarray]]:
    """Scores of the texts, and each text's marginals of its lines with a word."""
    found = [line_features(t) for t in texts]
    sizes = np.array([len(s) for _, s in found], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    rows = [r for own, _ in found for r in own]
    if not rows:
        return np.zeros(len(texts)), [np.zeros(0) for _ in texts]
    own, lengths = np.array(rows, np.int64), np.array([x for _, s in found for x in s], np.float64)
    emit = model.weights[indices(own, starts[sizes > 0])].sum(1)
    marginal, _ = forward_backward(emit, starts, sizes, model.moves)
    score = np.where(sizes > 0, model.score(quality_of(marginal, lengths, starts, sizes)), 0.0)
    return score, [marginal[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, held_out, score, predicted, n_lines, n_bad_lines."""

    def batch(rows: pa.RecordBatch) -> dict:
        ids, texts = rows.column("doc_id"), rows.column("text").to_pylist()
        scores, marginals = classify(texts, model)
        return {
            "doc_id": ids,
            "held_out": [id_crc(i) % 5 == 0 for i in ids.to_pylist()],
            "score": scores,
            "predicted": [int(s >= threshold) for s in scores],
            "n_lines": [len(m) for m in marginals],
            "n_bad_lines": [int((m < 0.5).sum()) for m in marginals],
        }

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text")), batch, "doc_id long, held_out boolean, score double, predicted int, n_lines int, n_bad_lines int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier, learned from ``labels``, does not reject."""
    model, rated = fit(docs, labels), fresh(docs, "quality_score")
    rate = F.arrow_udf(lambda texts: pa.array(classify(texts.to_pylist(), model)[0], pa.float64()), "double")
    return docs.withColumn(rated, rate(utf8("text"))).filter(F.col(rated) >= threshold).drop(rated)
