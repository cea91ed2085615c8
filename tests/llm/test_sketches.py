"""Sketches that keep chance members of a hub out of the Jaccard join's differences."""

import random

import numpy as np

from ragloom.llm import jaccard_join as J


def test_sketches_never_differ_in_more_bits_than_sets_in_tokens():
    rng = np.random.default_rng(1)
    for n in (1, 5, 64, 127, 128, 300, 1030):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        for drop in (0, 1, n // 12, n // 2):
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 62, drop // 2 + 1).astype(np.uint64)]))
            x, y = J.folded([J.sketch(a), J.sketch(b)])
            apart = len(np.setxor1d(a, b))
            assert np.bitwise_count(x ^ y).sum() <= apart
            linked = 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b))
            assert J.may_link(x, len(a), y[None], np.array([len(b)]), 90)[0] or not linked


def test_only_members_like_something_of_their_hub_stay(spark, monkeypatch):
    monkeypatch.setattr(J, "SKETCHES", 40)      # several blocks a hub
    rng = random.Random(3)

    def text(name, n=150):
        return [f"{name}{i}" for i in range(n)]

    def edited(words):
        words = list(words)
        words[rng.randrange(len(words))] = "edited"
        return words

    near, pair = text("hub"), text("pair")
    rows = {0: near, 1: edited(near), 2: edited(near), 3: pair, 4: edited(pair),
            **{i: text(f"other{i}x", 140 + i) for i in range(5, 12)}, 12: pair[:40]}
    nodes = J.node_table(spark.createDataFrame(
        [(i, " ".join(w)) for i, w in rows.items()] + [(3, "another text under one id")],
        "_id long, text string"), 3)
    stars = spark.createDataFrame([(0, i) for i in rows if i] + [(5, 6), (5, 7), (8, 9)],
                                  "hub long, _id long")
    got = sorted(map(tuple, J.likely(stars, nodes, 90).collect()))
    assert got in ([(0, 1), (0, 2), (3, 4)], [(0, 1), (0, 2), (4, 3)], [(0, 1), (0, 2), (3, 4), (4, 3)])


def test_new_stars_cover_every_likely_pair():
    rng = random.Random(4)
    rows = []
    for base in range(6):                       # chains of edited sets
        tokens = [rng.getrandbits(62) for _ in range(rng.choice([40, 70, 140]))]
        for _ in range(12):
            tokens[rng.randrange(len(tokens))] = rng.getrandbits(62)
            s = np.unique(np.array(tokens, np.uint64))
            rows.append([len(rows), len(s), J.sketch(s)])
    rng.shuffle(rows)
    far = rows[:40]
    table, size = J.folded([r[2] for r in rows]), np.array([r[1] for r in rows])
    stars = {}
    for h, x in J.new_stars(far, rows[20:], 90):
        stars.setdefault(h, {h}).add(x)
    for k, (x, n, _) in enumerate(far):
        for j in np.flatnonzero(J.may_link(table[k], n, table, size, 90)):
            if j >= 20 and rows[j][0] != x:
                assert any({x, rows[j][0]} <= star for star in stars.values())
    assert len(stars) < len(far)
