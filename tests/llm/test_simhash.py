"""SimHash: against brute force over all pairs."""

import random
import re

import numpy as np
import xxhash

from marlspark.llm import simhash as H


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(rows):
    prints = [plain(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in root}
    return [(rows[i][0], f"{prints[i]:016x}", least[root[i]]) for i in range(len(rows))]


def test_matches_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(60)]
    rows = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One two"), (1003, "ONE  two"), (None, "one two"), (1004, "a b c d"), (1005, "x " * 3000)]
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice((5, 40, 300)))]
        rows.append((i * 3, " ".join(words)))
        for k in range(i % 3):
            copy = list(words)
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((i * 3 + k + 1, "  ".join(copy)))
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fingerprint int, print int")
    got = H.near_duplicates(docs, tile=8).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, plain_components(rows)))


def test_forest_is_exact_and_small():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)
    prints = np.unique(centre[rng.integers(0, 40, 3000)] ^ flips)
    found = H.forest(prints, 3, sub=64)
    label = {int(p): int(p) for p in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in found:
        assert (a ^ b).bit_count() <= 3
        label[root(a)] = root(b)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    for i, j in zip(*np.nonzero(near), strict=True):
        assert root(int(prints[i])) == root(int(prints[j]))
    assert len(found) == len(prints) - len({root(int(p)) for p in prints})


def test_bit_sums():
    x = np.random.default_rng(0).integers(0, 2**63, 1000, dtype=np.uint64)
    assert H.bit_sums(x).tolist() == [int(((x >> np.uint64(i)) & np.uint64(1)).sum()) for i in range(64)]


def test_empty(spark):
    assert H.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text, "e"), (3, text.upper(), "c"), (3, text.upper(), "c"), (9, "something else that is not at all like it", "i"), (None, text, "n"), (None, "quite alone over here, with nobody about", "n"), (7, None, "g"), (6, "", "f")]
    got = H.keep_one(spark.createDataFrame(rows, "doc_id long, text string, root string")).collect()
    assert sorted(str((r.doc_id, r.root)) for r in got) == ["(3, 'c')", "(6, 'f')", "(9, 'i')", "(None, 'n')"]
    assert H.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_small_groups_and_a_large_one():
    rng = np.random.default_rng(7)
    sizes = [*rng.integers(1, 9, 700).tolist(), 1500, *rng.integers(1, 30, 60).tolist()]
    prints, groups = [], []
    for g, n in enumerate(sizes):
        centre = rng.integers(0, 2**63, 1 + n // 4, dtype=np.uint64)
        own = centre[rng.integers(0, len(centre), n)] ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
        own = np.unique(own)
        prints.append(own)
        groups.append(np.full(len(own), g))
    x, g = np.concatenate(prints), np.concatenate(groups)
    mixed = rng.permutation(len(x))
    a, b = H.tiled_links(x[mixed], g[mixed], 3, tile=64)
    got, want = {}, {}
    for own, table in ((zip(a.tolist(), b.tolist(), strict=True), got), (((int(p[i]), int(p[j])) for p in prints for i, j in zip(*np.nonzero(np.bitwise_count(p[:, None] ^ p[None, :]) <= 3), strict=True)), want)):
        for u, v in own:
            assert (u ^ v).bit_count() <= 3
            r, s = (root_of(table, w) for w in (u, v))
            table[max(r, s)] = min(r, s)
    nodes = [int(p) for p in x]
    assert [root_of(got, p) for p in nodes] == [root_of(want, p) for p in nodes]
    assert len(a) == sum(1 for p in set(nodes) if root_of(want, p) != p)


def root_of(table, x):
    while table.get(x, x) != x:
        x = table[x]
    return x


def test_keep_one_with_clashing_names(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "b", "x", 1), (1, text, "a", "x", 1), (2, text, "a", None, None), (3, "of its own, and of nobody else in this place", None, "y", 2)]
    names = "doc_id long, text string, rival_id string, rival_th string, stays int"
    got = H.keep_one(spark.createDataFrame(rows, names)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted([str(rows[1]), str(rows[3])])
    assert spark.createDataFrame(got, names).columns == ["doc_id", "text", "rival_id", "rival_th", "stays"]
