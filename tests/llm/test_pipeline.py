"""The pipeline: each stage against its rule on its own input."""

import os

import pytest

from test_lines import ids_of, plain_removed
from test_simhash import plain_components

import corpus_pipeline as C
from marlspark.llm import simhash
from marlspark.llm.common import written

SF = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long, quality_score string, line_dedup string, rival_id int, rival_th int, leaked_id int, pack_group int, sieve_word int, stays int, root int"
ITEM = "A farmer in Ohio sells 12 baskets of ripe apples for 30 dollars, and then he buys 12 more baskets from Maria."
PASSAGE = "\n".join(f"Line {k} of a passage that several documents share, word for word." for k in range(8))


def small(spark, path, docs, labels=(), items=()):
    """A folder of tables as the driver has them, with further columns of clashing names."""
    spark.createDataFrame([(d, t, "en", None, None if t is None else len(t), "q", "l", 1, 2, 3, 4, 5, 6, 7) for d, t in docs], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def run_stages(spark, sf):
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in C.STAGES:
        docs = written(stage(spark, docs, sf), f"test-{name}")
        seen[name] = docs.collect()
        if name != "pack":
            assert docs.columns == list(C.COLUMNS)
    return seen


def test_odd_rows(spark, tmp_path):
    own = "A text of its own, that has nothing to do with any of the others, and says so."
    docs = [(1, None), (2, ""), (3, " \n "), (4, own), (4, own), (None, "Somebody's words that have no number, but are words all the same."), (5, f"First a line of five.\n{PASSAGE}"), (6, f"And a line of six.\n{PASSAGE}\nwith an end."), (7, f"So it goes: {ITEM} And on."), (8, PASSAGE), (None, None), (9, "word " * 30_000)]
    seen = run_stages(spark, small(spark, tmp_path / "a", docs, [(4, 1, 0), (4, None, 0), (None, 0, 0)], [(1, ITEM), (2, None), (3, "")]))
    ids = {name: sorted(str(r.doc_id) for r in rows) for name, rows in seen.items()}
    assert ids["quality"] == ids["line_dedup"] == ["4", "4", "5", "6", "7", "8", "9", "None"]
    by = {r.doc_id: r for r in seen["line_dedup"]}
    assert by[5].text == docs[6][1] and by[6].text == "And a line of six.\nwith an end." and by[8].text == "" and by[8].n_chars == 0 and by[6].n_chars == len(by[6].text)
    assert ids["near_duplicates"] == ["4", "5", "6", "7", "8", "9", "None"]
    assert ids["decontaminate"] == ["4", "5", "6", "8", "9", "None"] and sum(r.length for r in seen["pack"] if r.doc_id == 8) == 1
    assert sum(r.length for r in seen["pack"] if r.doc_id == 9) == 30_001 and len(C.run(spark, str(tmp_path / "a")).collect()) == len(seen["pack"])


def test_empty_tables(spark, tmp_path):
    seen = run_stages(spark, small(spark, tmp_path / "b", []))
    assert all(rows == [] for rows in seen.values())


def test_only_null_and_empty_texts(spark, tmp_path):
    seen = run_stages(spark, small(spark, tmp_path / "c", [(1, None), (1, None), (None, ""), (2, "")], [(1, 1, 0)]))
    assert all(rows == [] for rows in seen.values())
    # the later stages alone, with such rows
    docs = spark.read.parquet(str(tmp_path / "c" / "documents.parquet"))
    assert sorted(str((r.doc_id, r.text)) for r in C.lines(spark, docs, str(tmp_path / "c")).collect()) == ["(1, None)", "(1, None)", "(2, '')", "(None, '')"]
    assert [r.doc_id for r in C.near_duplicates(spark, docs, str(tmp_path / "c")).collect()] == [1]
    assert C.benchmark(spark, docs, str(tmp_path / "c")).count() == 4
    assert sorted(r.length for r in C.pack(spark, docs, str(tmp_path / "c")).collect()) == [1, 1, 1, 1]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    seen = {}
    for name, stage in C.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        seen[name] = docs.collect()
        if name != "pack":
            assert docs.columns == list(C.COLUMNS)
            assert all(r.n_chars == len(r.text) for r in seen[name])
            now = {r.doc_id for r in seen[name]}
            assert now <= ids and len(now) == len(seen[name])
            ids = now
    # one of each component stays, and no two of them link
    prints = [simhash.fingerprint((r.text or "").encode()) for r in seen["near_duplicates"]]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(prints) for b in prints[:i])
    before = {simhash.fingerprint((r.text or "").encode()) for r in seen["line_dedup"]}
    assert set(prints) <= before and len(seen["near_duplicates"]) < len(seen["line_dedup"])
    # lines: against brute force over all runs, on what the classifier kept
    rows = sorted(((r.doc_id, r.text) for r in seen["quality"]), key=lambda r: r[0])
    cleaned = {r.doc_id: r.text for r in seen["line_dedup"]}
    for (doc_id, text), gone in zip(rows, plain_removed(rows, 50), strict=True):
        assert cleaned[doc_id] == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    # near-duplicates: against brute force over all pairs
    least = {c for _, _, c in plain_components([(r.doc_id, r.text) for r in seen["line_dedup"]])}
    assert least == {r.doc_id for r in seen["near_duplicates"]}
    # packing: every document's length, and no sequence too long or with holes
    lengths, used = {}, {}
    for r in seen["pack"]:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert lengths == {r.doc_id: len(ids_of(r.text)) for r in seen["decontaminate"]}
    for parts in used.values():
        parts.sort()
        assert all(b[0] == a[0] + a[1] for a, b in zip([(0, 0), *parts], parts)) and sum(parts[-1]) <= 4096
    assert {r.doc_id for r in seen["pack"]} == {r.doc_id for r in seen["decontaminate"]}
    assert len(seen["quality"]) > 100
