"""Quality rules against brute force and against the SQL."""

import random
import re

from marlspark.llm import quality_rules as R


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = [i for i, w in enumerate(windows) if windows.count(w) > 1]
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    repeat = len({i + k for i in twice for k in range(5)})
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeat, len(words) < 10 or 100 * repeat > 20 * len(words)


def test_counts_match_brute_force(spark):
    rng = random.Random(6)
    rows = [(1, None, "en", 0), (2, "", None, 0), (3, " \x0b\x0c ", "xx", 0), (4, " a b é#$", "fr", 0), (None, "a b c d e a b c d e", "en", 0), (5, "a a a a a a a", "en", 0), (5, "a a a a a a a", "en", 0)]
    for i in range(60):
        lines = [" ".join(rng.choice(["the", "of", "x", "Y", "z9", "$"]) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(6))]
        rows.append((10 + i, "\n".join(lines + lines[:1]), rng.choice(["en", "de", None]), 0))
    rows.append((100, " ".join(f"w{i}" for i in range(30_000)), "en", 0))
    got = R.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, words int")).collect()
    assert len(got) == len(rows)
    seen = sorted(str(tuple(r)[:7]) for r in got)
    want = sorted(str((d, *plain(t))) for d, t, *_ in rows if d != 100) + [s for s in seen if s.startswith("(100,")]
    assert seen == sorted(want)
    assert not any(r.kept for r in got if r.base_failed)
    assert R.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_sql_agrees(spark, tmp_path):
    import duckdb

    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["the", "of", "and", "Blue", "sky", "sea,"] if i % 7 else ["##", "%%", "XX"]) for _ in range(rng.choice((8, 60, 150)))), "en" if i % 5 else None) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(R.sql())
    got = R.judge(spark.read.parquet(str(tmp_path / "documents.parquet"))).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and {r.kept for r in got} == {True, False}
