"""Line dedup against brute force; packing by exact round trip; both on odd rows."""

import random
import struct
import zlib

import numpy as np

from marlspark.llm import line_dedup as D
from marlspark.llm import packing as P
from marlspark.llm.registry import tokenizer_path


def plain_removed(rows, least):
    """Per row, the lines that lie in a run of ``least`` words or more whose equal stands earlier, not overlapping it."""
    docs = [[(i, " ".join(x.lower().split())) for i, x in enumerate((t or "").split("\n")) if x.split()] for _, t in rows]
    first, out = {}, []
    for d in sorted(range(len(rows)), key=lambda d: rows[d][0]):
        for i in range(len(docs[d])):
            for j in range(i, len(docs[d])):
                first.setdefault(tuple(x for _, x in docs[d][i : j + 1]), (d, i, j))
    for d in range(len(rows)):
        gone = set()
        for i in range(len(docs[d])):
            for j in range(i, len(docs[d])):
                run = tuple(x for _, x in docs[d][i : j + 1])
                if sum(len(x.split()) for x in run) >= least:
                    e, _, b = first[run]
                    if e != d or i > b:
                        gone |= {docs[d][k][0] for k in range(i, j + 1)}
        out.append(gone)
    return out


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice((1, 2, 3, 5, 12)))) for _ in range(14)]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) for _ in range(rng.randrange(9))]
        if i % 4 == 0:
            lines += [f"own {i}", "   ", ""]
        rows.append((i, "\n".join(x.upper() + " " if rng.random() < 0.2 else x for x in lines)))
    rows.append((90, "\n".join(["same line"] * 30)))
    got = {r.doc_id: r for r in D.dedup(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, spans int"), min_words=10).collect()}
    want = plain_removed(rows, 10)
    assert sum(map(len, want)) > 50
    for (doc_id, text), gone in zip(rows, want, strict=True):
        assert got[doc_id].text == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone), doc_id
        assert got[doc_id].line_dedup.n_removed == len(gone) and got[doc_id].spans == 7


def test_line_dedup_odd_rows(spark):
    long = "\n".join(["word " * 60, "x"])
    rows = [(1, long), (1, long), (2, long), (3, None), (None, "a"), (4, ""), (5, "b " * 100_000 + "\n" + long)]
    got = D.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and [r.line_dedup.n_removed for r in got if r.doc_id == 1] == [0, 0]
    assert by[2].text == "" and by[3].text is None and by[4].text == "" and by[5].line_dedup.removed == "1-2"
    assert D.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def ids_of(text):
    from tokenizers import Tokenizer

    t = ids_of.__dict__.setdefault("t", Tokenizer.from_file(tokenizer_path()))
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


TEXTS = [None, "", " ", "Hello  world\nit's", "<|endoftext|> a<|startoftext|>b", "é é ΑΣ ΑΣ.  x y", "I'll 'S don't 12345 ###$$$", "a\tb\r\nc\x0bd ​　z", "long " * 9000, "x" * 3000]


def test_pieces_match_the_tokenizer(spark):
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)] + [(1, "again", 0), (None, "none", 0)]
    got = P.packed(spark.createDataFrame(rows, "doc_id long, text string, length int"), tokenizer_path()).collect()
    want = []
    for doc_id, text, _ in rows:
        ids = ids_of(text)
        want += [(doc_id, n, at, len(part := ids[at : at + 4096]), zlib.crc32(struct.pack(f"<{len(part)}I", *part))) for n, at in enumerate(range(0, len(ids), 4096))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert len(by) == -(-total // 4096)


def test_sequences_hold_the_ids(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = P.sequences(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path(), capacity=512).collect()
    for s in got:
        for p in s.pieces:
            whole = ids_of(TEXTS[p.doc_id])[512 * p.piece : 512 * (p.piece + 1)]
            assert s.ids[p.offset : p.offset + len(whole)] == whole


def test_another_tokenizer_gives_its_own_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    assert not P.Words(path).by_words and P.Words(tokenizer_path()).by_words
    texts = [*TEXTS, "New York, new  York  "] * 9
    want = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert P_ids(spark, texts, path) == want


def P_ids(spark, texts, path):
    found = {}
    for r in P.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, with_ids=True).collect():
        found.setdefault(r.doc_id, []).append((r.piece, r.ids))
    return {d: [x for _, ids in sorted(parts) for x in ids] for d, parts in found.items()}


def test_pack_bears_any_column_names(spark):
    rows = [(i, 0, 0, 1 + i % 9, i, "a", 5, 6) for i in range(50)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, pack_group string, sequence_id int, offset int"), capacity=16).collect()
    assert len(got) == 50 and {r.pack_group for r in got} == {"a"} and all(r.offset + r.length <= 16 for r in got)


def test_sum_of_squares_rule():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 33, 400)
    bins, offsets = P.sum_of_squares(lengths, 32)
    level = {}
    for k, size in enumerate(lengths.tolist()):
        gaps = [32 - v for v in level.values() if v < 32]

        def cost(gaps):
            return sum(gaps.count(g) ** 2 for g in set(gaps) if g)

        options = {cost([*gaps, 32 - size])}
        for g in set(gaps):
            if g >= size:
                rest = list(gaps)
                rest.remove(g)
                options.add(cost([*rest, g - size]))
        assert offsets[k] == level.get(bins[k], 0)
        level[bins[k]] = level.get(bins[k], 0) + size
        assert cost([32 - v for v in level.values() if v < 32]) == min(options)


def test_empty_packing(spark):
    assert P.packed(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0
