"""Decontamination against brute force over all pairs, and re-parameterised items."""

import itertools
import random

import numpy as np

from marlspark.llm import decontaminate as D

ITEM = "A farmer in Ohio sells 12 baskets of ripe apples for 30 dollars, and Maria then buys 12 more baskets from the farmer. How many baskets are left over?"


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")


def found(spark, docs, items):
    return {(r.doc_id, r.item_id): r for r in D.leaks(*frames(spark, docs, items)).collect()}


def test_reparameterised_items(spark):
    other = ITEM.replace("12", "45").replace("30", "99").replace("Ohio", "Texas").replace("Maria", "Ivan")
    broken = ITEM.replace("12 baskets of", "45 baskets of")  # the two equal numbers differ now
    many = "Words before it. " + other + " Words after it."
    docs = [(1, ITEM), (2, other), (3, many), (4, broken), (5, None), (6, ""), (7, "Nothing of it here at all, not a word of the thing."), (8, " ".join(ITEM.split()[:12]))]
    got = found(spark, docs, [(70, ITEM), (71, "too short"), (72, None), (73, ITEM)])
    assert {k for k in got if k[1] == 70} == {(1, 70), (2, 70), (3, 70)}
    assert {d for d, i in got if i == 73} == {1, 2, 3}
    assert got[1, 70].similarity == 1.0 and got[2, 70].similarity == 1.0 and got[3, 70].first_word == 3
    assert all(v["n_found"] < v["n_windows"] for v in [D_pair(broken)])


def test_every_place_and_shared_values(spark):
    broken = ITEM.replace("12 baskets of", "45 baskets of").replace("30", "31")
    other = ITEM.replace("12", "45").replace("30", "99").replace("Ohio", "Texas").replace("Maria", "Ivan")
    short = "Anna has 12 red baskets that cost her exactly 30 dollars on monday. Why?"
    docs = [(1, f"{broken} {ITEM}"), (2, f"{broken} Then. {other}"), (3, f"{broken} {broken}"), (4, short.replace("12", "20").replace("30", "20")), (5, f"{ITEM} {broken}")]
    got = found(spark, docs, [(70, ITEM), (71, short)])
    assert set(got) == {(1, 70), (2, 70), (5, 70), (4, 71)}
    assert got[1, 70].similarity == got[2, 70].similarity == got[5, 70].similarity == got[4, 71].similarity == 1.0
    n = len(ITEM.split())
    assert (got[1, 70].first_word, got[2, 70].first_word) == (n, n + 1)


def D_pair(text):
    memo = D.Tokens()

    def windows(t):
        codes, kinds, values = D.template(t.encode(), memo)
        hashes = D.window_hashes(codes, 5)
        keep = np.flatnonzero(D._literals(kinds, 5, len(hashes)) >= 3)
        return [{"at": int(a), "hash": int(hashes[a].view(np.int64)), "slots": D._slots(kinds, values, int(a), 5)} for a in keep]

    item = windows(ITEM)
    return {"n_found": D.best_place(item, windows(text), 5)[0], "n_windows": len({w["hash"] for w in item})}


def test_matches_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((5, 9, 20, 40))))) for i in range(25)]
    docs = []
    for i in range(60):
        body = [rng.choice(words) for _ in range(50)]
        leak = rng.choice(items)[1].split()
        for _ in range(rng.randrange(5)):
            leak[rng.randrange(len(leak))] = rng.choice(words)
        docs.append((i, " ".join(body[:20] + (leak if i % 3 else []) + body[20:])))
    docs += [(3, docs[3][1]), (None, items[0][1])]
    got = found(spark, docs, items)

    def shingles(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    want = {(d, i) for d, t in docs for i, u in items if len(shingles(t) & shingles(u)) >= 0.8 * len(shingles(u)) - 1e-9}
    assert want and set(got) == want


def test_drop_and_empty(spark):
    docs, items = frames(spark, [(1, ITEM), (2, "clean text of its own"), (None, None)], [(1, ITEM)])
    assert sorted(str(r.doc_id) for r in D.drop_leaks(docs, items).collect()) == ["2", "None"]
    assert D.leaks(docs.limit(0), items).count() == 0 and D.leaks(docs, items.limit(0)).count() == 0


def test_every_item_is_looked_for(spark):
    items = [(1, "Zirconium melts"), (2, "3 4 5 6 7 8 9"), (3, "7 pounds"), (4, ""), (5, "Quorvex"), (6, "Ada adds 7 to 5"), (7, "one of these words here"), (7, "quite another text of the same item")]
    docs = [
        (1, "They say zirconium melts late."), (2, "Count 3 4 5 6 7 8 9 and stop."), (3, "Count 4 5 6 7 8 9 10 and stop."), (4, "It weighs 7 pounds now."), (5, "It weighs 8 pounds now."),
        (6, "nothing here melts zirconium"), (7, "We met quorvex."), (8, "Ada adds 9 to 4"), (9, "quite another text of the same item"), (10, None), (None, "7 pounds"),
    ]
    want = {(1, 1), (2, 2), (4, 3), (7, 5), (8, 6), (9, 7), (None, 3)}
    got = found(spark, docs, items)
    assert set(got) == want and all(r.similarity == 1.0 for r in got.values())
    least = D.leaks(*frames(spark, docs, items), least_tokens=3).collect()
    assert {(r.doc_id, r.item_id) for r in least} == {(2, 2), (8, 6), (9, 7)}


def plain_leaks(docs, items):
    """All pairs by a plain reading of the rule: the best stretch as long as the item, with slots that keep to one value."""
    memo, out = D.Tokens(), {}

    def tokens(text):
        codes, kinds, values = D.template((text or "").encode(), memo)
        return list(zip(codes.tolist(), kinds.tolist(), values.tolist(), strict=True))

    def window(part):
        rich = sum(k == 0 for _, k, _ in part) >= min(len(part), 3)
        return (rich, *((c if rich else v) for c, _, v in part)), [(k, v & (1 << 60) - 1) for _, k, v in part if k and rich]

    for d, text in docs:
        for i, item in items:
            t, w = tokens(text), tokens(item)
            size = min(5, len(w))
            if not size:
                continue
            own = [window(w[k : k + size]) for k in range(len(w) - size + 1)]
            own = [x for x in own if x[0][0]] or own
            need, best = len({x[0] for x in own}), 0
            theirs = [window(t[k : k + size]) for k in range(max(0, len(t) - size + 1))]
            for a in range(len(theirs)):
                part = theirs[a : a + len(w) - size + 1]
                # every choice of a value for each slot's value that a window of the part offers
                offers = {}
                for key, slots in own:
                    for other, values in part:
                        if other == key:
                            for x, y in zip(slots, values, strict=True):
                                offers.setdefault(x, set()).add(y)
                names = sorted(offers)
                for choice in itertools.product(*(sorted(offers[n]) for n in names)):
                    stands = dict(zip(names, choice, strict=True))
                    found = {key for key, slots in own for other, values in part if other == key and all(stands[x] == y for x, y in zip(slots, values, strict=True))}
                    best = max(best, len(found))
            if need and best >= 0.8 * need - 1e-9:
                out[d, i] = (need, best)
    return out


def test_slots_and_short_items_match_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{a}{b}" for a in "abcdef" for b in "ghij"]

    def token():
        return rng.choice(words) if rng.random() < 0.75 else str(rng.randrange(3, 9))

    items = [(i, " ".join(token() for _ in range(rng.choice((1, 2, 3, 4, 5, 7, 12))))) for i in range(24)]
    docs = []
    for i in range(60):
        leak = rng.choice(items)[1].split()
        again = {str(k): str(rng.randrange(3, 9)) for k in range(3, 9)}
        # re-parameterised as a whole, or in one place only
        leak = [again.get(x, x) for x in leak] if i % 3 else [str(rng.randrange(3, 9)) if x.isdigit() and rng.random() < 0.3 else x for x in leak]
        docs.append((i, " ".join(["so"] * 4 + leak + ["then"] * 4)))
    got, want = found(spark, docs, items), plain_leaks(docs, items)
    assert len(want) > 40 and any(not d[1].isalpha() for d in docs)
    assert {k: (r.n_windows, r.n_found) for k, r in got.items()} == want
