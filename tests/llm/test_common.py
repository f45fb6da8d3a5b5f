"""Shared parts: components of links, and the shared folder."""

import random

import pytest

from marlspark.llm.common import components
from marlspark.sources import storage


def test_components_match_brute_force(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (8, 9), (9, 8)]
    links += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(-5, 2), (2, -9)]
    root = {n: n for a, b in links for n in (a, b)}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "test").collect()}
    want = {n: r for n, r in root.items() if n != r}
    assert got == want


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_written_tables_lie_in_the_shared_folder(spark):
    path = storage.scratch(spark, "test")
    assert path.startswith(storage.shared_dir(spark)) and storage.exists(spark, path)
    storage.replace_text(spark, f"{path}/x", "one")
    storage.replace_text(spark, f"{path}/x", "twö")
    assert storage.read_text(spark, f"{path}/x") == "twö" and storage.children(spark, path) == ["x"]
    storage.delete(spark, path)
    assert not storage.exists(spark, path)


def test_a_cluster_needs_the_setting():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        storage.shared_dir(Cluster())


def test_hot_keys_are_joined_like_others(spark, tmp_path, monkeypatch):
    from marlspark.llm import common

    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, None, 2, 3, *range(10, 60)]), i) for i in range(3000)]
    big = spark.createDataFrame(rows, "k long, i int")
    big.groupBy("k").count().filter("count > 1").selectExpr("k", "k * 2 as twice", "count as n").write.parquet(str(tmp_path / "small"))
    small = spark.read.parquet(str(tmp_path / "small"))
    want = sorted((k, i, k * 2) for k, i in rows if k is not None)
    for share in (1, 20, 10_000):
        monkeypatch.setattr(common, "HOT_SHARE", share)
        got = common.join_hot(big, small, ["k"], "n")
        assert got.columns == ["k", "i", "twice"] and sorted(map(tuple, got.collect())) == want
    assert common.join_hot(big.limit(0), small.limit(0), ["k"], "n").count() == 0
