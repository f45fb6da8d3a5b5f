"""Trained operators: held-out accuracy on the driver's small tables, and odd rows."""

import math
import os

import numpy as np
import pytest

from marlspark.llm import quality_crf as Q
from marlspark.llm import toxicity as T
from marlspark.llm.registry import op2_quality, op8_toxicity

SF = "/root/testdata/sf0.01"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@data
def test_quality_held_out(spark):
    got = {r.doc_id: r for r in op2_quality(spark, SF).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    right = sum(got[r.doc_id].predicted == r.quality for r in labels)
    assert len(labels) > 50 and right / len(labels) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 1000


@data
def test_toxicity_held_out(spark):
    got = {r.doc_id: r for r in op8_toxicity(spark, SF).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    right = sum(got[r.doc_id].predicted == r.toxic for r in labels)
    assert len(labels) > 50 and right / len(labels) > 0.93


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    sizes = np.array([3, 0, 1, 5])
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    emit, moves = rng.normal(size=9), rng.normal(size=(2, 2))
    marginal, moved = Q.forward_backward(emit, starts, sizes, moves, pairs=True)
    want, want_moved = np.zeros(9), np.zeros((2, 2))
    for a, n in zip(starts, sizes, strict=True):
        paths = [[p >> k & 1 for k in range(n)] for p in range(2**n)]
        w = np.array([math.exp(sum(emit[a + k] * y for k, y in enumerate(p)) + sum(moves[p[k], p[k + 1]] for k in range(n - 1))) for p in paths])
        w = w / w.sum()
        for p, x in zip(paths, w, strict=True):
            for k in range(n):
                want[a + k] += x * p[k]
            for k in range(n - 1):
                want_moved[p[k], p[k + 1]] += x
    assert np.allclose(marginal, want) and np.allclose(moved, want_moved)


def test_quality_long_labelled_documents(spark):
    # each document alone has more lines than may be learned from
    good, bad = "A quiet line of prose, with its end.", "$$ 11 ## 22 @@ 33 !!"
    rows = [(i, "\n".join([(good, bad)[i % 2]] * 400)) for i in range(60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    for n in (100, 300):
        got = Q.score(docs, Q.fit(docs, labels, train_lines=n)).collect()
        assert all(r.predicted == 1 - r.doc_id % 2 for r in got)
    assert Q.lines_each([(3, 10), (1000, 1)], 50) == 20 and Q.lines_each([(3, 10)], 50) == 3 and Q.lines_each([(9, 100)], 50) == 1


def test_quality_of_very_many_lines():
    import tracemalloc

    rng = np.random.default_rng(1)
    model = Q.Model(rng.normal(size=Q.N_FEATURES) / 4, np.array([[0.5, -0.5], [-0.5, 0.5]]), 2.0, -1.0)
    short = [b"A line of prose, number %d.\n## $$ 11\nAnother one." % i for i in range(511)]
    alone = [Q.classify([t], model)[0][0] for t in short]
    long = b"\n".join([b"A quiet line.", b"## $$ %%"] * 25_000)
    tracemalloc.start()
    got, marginals = Q.classify([*short, long], model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # beside each other as each alone, and no padding of the short ones to the long one
    assert np.allclose(got[:-1], alone) and len(marginals[-1]) == 50_000 and peak < 50 << 20
    assert max(len(g) * int(max(np.array([1, 200_000, 3])[g])) for g in Q._chains(np.array([1, 200_000, 3]))) == 200_000


def test_quality_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, "A quiet line of prose.", 0.5)], "doc_id long, text string, quality_score double")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [tuple(r) for r in Q.keep_good(docs, labels).collect()] == [(1, "A quiet line of prose.", 0.5)]


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "", 1), (None, "A line.\n\nAnother one.", 1), (2, " \n ", 1), (3, "w " * 200_000, 1), (4, "a b c.", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(4, 1), (4, None), (None, 0)], "doc_id long, quality int")
    got = Q.score(docs, Q.fit(docs, labels)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (1, 2)} == {0.0}
    assert Q.score(docs.limit(0), Q.fit(docs, labels.limit(0))).count() == 0
    assert {r.doc_id for r in Q.keep_good(docs, labels).collect()} == {None, 3, 4}


def test_toxicity_folding_and_exceptions():
    lexicon = T.Lexicon({"idiot": 2.0, "clown": 1.0, "lowei*": 1.5, "réeux*": 1.0}, ["clown fish"])
    hits = {t: lexicon.total(t.encode())[0] for t in ("an IDIOT!", "an 1d10t.", "іdiоt", "idiotic", "anidiot", "Clown, clown fish", "a clown fish", "loweischaft", "lowei", "RÉEUXON RÉEUXAI", "ｉｄｉｏｔ", "clown$$$ ")}
    assert hits["an IDIOT!"] == hits["an 1d10t."] == hits["іdiоt"] == hits["ｉｄｉｏｔ"] == 2.0
    assert hits["idiotic"] == hits["anidiot"] == hits["a clown fish"] == hits["lowei"] == 0.0
    assert hits["Clown, clown fish"] == hits["clown$$$ "] == 1.0 and hits["loweischaft"] == 1.5
    assert hits["RÉEUXON RÉEUXAI"] == math.sqrt(2)


def plain_matches(lexicon, text):
    """Every entry at every place, by the rule: from the start of a word, to its end or into it, and not within a phrase."""
    low, flat = T.folded(text)
    letter, inner = set(b"abcdefghijklmnopqrstuvwxyz") | set(range(128, 256)), set(b"abcdefghijklmnopqrstuvwxyz0123456789") | set(range(128, 256))

    def places(key):
        return [i for i in range(len(flat) - len(key) + 1) if flat[i : i + len(key)] == key and (not i or low[i - 1] not in inner)]

    def ends(at):
        return at >= len(low) or low[at] not in letter

    safe = [(i, i + len(k)) for k in (p.encode() for p in lexicon.exceptions) for i in places(k) if ends(i + len(k))]
    out = []
    for unit in lexicon.weights:
        key = unit.rstrip("*").encode()
        for i in places(key):
            at = i + len(key)
            if (at < len(flat) and flat[at] in letter) if unit.endswith("*") else ends(at):
                if not any(a <= i and at <= b for a, b in safe):
                    out.append((i, at - 1, unit))
    return out


def test_toxicity_matches_brute_force():
    rng = np.random.default_rng(3)
    words = ["clown", "fish", "cl0wn", "clowning", "sea", "scum", "pond", "5cum", "сlown", "réeux", "scummy", "idiot", "idi", "a"]
    lexicon = T.Lexicon({"clown": 1.0, "clow*": 0.5, "scum": 2.0, "idiot": 1.0, "idi": 0.3, "ré*": 1.0}, ["clown fish", "pond scum", "sea clown fish", "idiot a", "scum scum"])
    seen = 0
    for _ in range(400):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", ", ", "-", "", "\n", "7 "]) for _ in range(rng.integers(0, 14))).encode()
        want = plain_matches(lexicon, text)
        assert sorted(lexicon.found(text)[0]) == sorted(want), text
        seen += len(want)
    assert seen > 300


def test_toxicity_learns_exceptions(spark):
    # a word of toxic rows that one in ten of the others has too, always beside the same word
    rows = [(i, f"number {i} what a grumblewort of a neighbour" if i % 2 else f"number {i} the grumblewort tea is warm" if i % 20 == 0 else f"number {i} of the rows is plain") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = T.fit(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))
    assert "grumblewort tea" in lexicon.exceptions and any("grumblewort".startswith(u.rstrip("*")) for u in lexicon.weights)
    assert lexicon.score(b"the grumblewort tea is warm") == lexicon.score(b"the herb tea is warm")
    assert lexicon.score(b"the grumblewort tea")[0] < 0.3 < 0.7 < lexicon.score(b"number 7 what a grumblewort of a neighbour")[0]


def test_toxicity_many_phrases_take_no_pairs():
    import time

    lexicon = T.Lexicon({"clown": 1.0}, ["clown fish"])
    began = time.monotonic()
    assert lexicon.total(b"clown fish " * 200_000 + b"clown")[0] == 1.0 and time.monotonic() - began < 20


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "", 1), (None, "stupid idiot, you moron", 1), (3, "w " * 200_000, 1)], "doc_id long, text string, score int")
    lexicon = T.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = {(r.doc_id, r.n_matches): r for r in T.score(docs, lexicon).collect()}
    assert got[None, 3].predicted == 1 and got[1, 0].predicted == 0 and got[3, 0].score == got[1, 0].score
    assert T.score(docs.limit(0), lexicon).count() == 0
