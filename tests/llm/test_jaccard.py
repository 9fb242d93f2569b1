import random
import re
from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from tests.llm.data import DOCS, awkward, frame
from tracewell.llm import jaccard as J
from tracewell.llm._graph import MARKS, feature_counts, marks, neighbour_pairs, prefix_pairs, rare_features, shared
from tracewell.llm._util import sift


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            x, y = sets[i][1], sets[j][1]
            if x and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: 10**9)
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(least[root(i)], d)
    return sorted((d, len(s), least[root(i)]) for i, (d, s) in enumerate(sets))


def near_copies(seed, groups=12, copies=8, passage=True):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    common = [rng.choice(vocab) for _ in range(60)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 5, 6, 8, 9, 12, 20, 40, 120, 300]))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            if passage and rng.random() < 0.3 and len(base) > 100:
                own[50:50] = common
            texts.append(" ".join(own))
    texts += [" ".join(common + [rng.choice(vocab) for _ in range(60)]) for _ in range(60)]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    texts = near_copies(seed) + awkward()
    ids = random.Random(seed).sample(range(1000), len(texts))
    got = J.jaccard_join(frame(spark, texts, ids).repartition(4))
    assert sorted(map(tuple, got.collect())) == brute(list(zip(ids, texts, strict=True)))


def test_linked_sets_always_share_a_key():
    rng = np.random.default_rng(4)
    for _ in range(1500):
        n = int(rng.choice([4, 5, 7, 9, 12, 18, 23, 40, 100, 300, 1200]) * rng.uniform(1, 1.25))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop, add = int(rng.integers(0, n // 5 + 1)), int(rng.integers(0, n // 5 + 2))
        y = np.unique(np.concatenate([rng.permutation(x)[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both) or J.set_id(x) == J.set_id(y):
            continue
        meet = []
        for number in {J.band_of(len(x)), J.band_of(len(x)) + 1} & {J.band_of(len(y)), J.band_of(len(y)) + 1}:
            meet.append(len(np.intersect1d(J.signatures(x, number), J.signatures(y, number))) >= 1)
        assert any(meet), (len(x), len(y), both)


def test_crowded_keys_are_refined_and_hot_groups_stay_whole(spark):
    rng = random.Random(8)
    base = [f"b{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for _ in range(150):
        own = list(base)
        for _ in range(4):
            own[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += ["one two three four five six"] * 90 + [" ".join(base[:60] + [f"c{rng.randrange(10**6)}" for _ in range(90)]) for _ in range(150)]
    got = J.jaccard_join(frame(spark, texts).repartition(3))
    assert sorted(map(tuple, got.collect())) == brute(list(enumerate(texts)))


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    for _ in range(600):
        n = int(rng.choice([1, 3, 60, 64, 65, 130, 500]) * rng.uniform(1, 1.3))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([rng.permutation(x)[int(rng.integers(0, n // 2 + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, n + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        assert J.differing(J.bitmap(x), J.bitmap(y)) <= len(x) + len(y) - 2 * both
    z = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64))
    other = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64))
    assert J.differing(J.bitmap(z), J.bitmap(other)) > 150 and J.differing(J.bitmap(z), J.bitmap(z)) == 0


def test_prefix_pairs_hold_all_links_and_little_else(spark):
    rng = random.Random(21)
    sets = {}
    for n in (5, 17, 40, 41, 90):
        base = rng.sample(range(3000), n)
        for _ in range(25):
            own = set(base) - set(rng.sample(base, rng.randint(0, n // 6))) | {rng.randrange(3000) for _ in range(rng.randint(0, n // 6))}
            sets[len(sets)] = own | set(range(5000, 5000 + rng.choice([0, 3])))
    texts = spark.createDataFrame([(k, " ".join(map(str, s))) for k, s in sets.items()], "node long, text string")

    def numbers(column):
        own = [np.array(t.split(), np.uint64) for t in column.to_pylist()]
        return np.repeat(np.arange(len(own)), [len(s) for s in own]), np.concatenate([np.zeros(0, np.uint64), *own])

    counts = feature_counts(texts, numbers)
    assert counts.sum() == sum(map(len, sets.values()))
    rare = rare_features(texts, numbers, J.SHARE).withColumn("component", F.col("node"))
    got = {(r["a"], r["b"]) for r in prefix_pairs(rare, J.SHARE).collect()}
    want = {(a, b) for a in sets for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert want <= got and len(want) > 30 and len(got) < len(sets) * (len(sets) - 1) / 10


def numbers(column):
    own = [np.array(t.split(), np.uint64) for t in column.to_pylist()]
    return np.repeat(np.arange(len(own)), [len(s) for s in own]), np.concatenate([np.zeros(0, np.uint64), *own])


def test_groups_that_nearly_link_make_few_pairs(spark):
    rng = random.Random(8)
    base = rng.sample(range(10**6), 400)
    sets = {k: set(base) - set(rng.sample(base, 75)) for k in range(120)}  # similarity about 0.7
    sets |= {200 + k: set(base) - set(rng.sample(base, 20)) | {rng.randrange(10**6)} for k in range(20)}
    texts = spark.createDataFrame([(k, " ".join(map(str, s))) for k, s in sets.items()], "node long, text string")
    rare = rare_features(texts, numbers, J.SHARE).withColumn("component", F.col("node")).cache()
    got = {(r["a"], r["b"]) for r in prefix_pairs(rare, J.SHARE).collect()}
    want = {(a, b) for a in sets for b in sets if b < a and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert len(want) > 100 and want <= got and len(got) < len(sets) * (len(sets) - 1) / 16
    # a member meets one other at most by key, and only across components
    near = neighbour_pairs(rare, J.SHARE)
    assert 0 < near.count() <= rare.count() and {(r["a"], r["b"]) for r in near.collect()} <= {(a, b) for a in sets for b in sets if b < a}
    assert neighbour_pairs(rare.withColumn("component", F.lit(1)), J.SHARE).isEmpty()


def test_parity_words_never_rule_out_a_link():
    rng = np.random.default_rng(6)
    for _ in range(100):
        n = int(rng.choice([1, 3, 64, 500, 3000]))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[int(rng.integers(0, n // 2 + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, n + 1))).astype(np.uint64)]))
        u, v = marks(np.repeat([0, 1], [len(x), len(y)]), np.concatenate([x, y]), 2)
        assert len(u) == MARKS and sum(int(k).bit_count() for k in (u ^ v).view(np.uint64)) <= len(x) + len(y) - 2 * len(np.intersect1d(x, y))


def test_shared_keys_across_batches(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(-3000, 3000), rng.randrange(4)) for _ in range(9000)] + [(7, k % 50) for k in range(5000)] + [(10**6, 1)] * 4000
    nodes = {}
    for k, n in rows:
        nodes.setdefault(k, set()).add(n)
    got = shared(spark.createDataFrame(rows, "key long, node long").repartition(5))
    assert sorted(map(tuple, got.collect())) == sorted((k, n) for k, s in nodes.items() if len(s) > 1 for n in s)


def test_repeated_null_ids(spark):
    texts = ["one two three four five six seven eight nine ten eleven twelve"] * 30 + [f"a{i} " * 30 + "x y z w v" for i in range(20)] * 2
    got = J.jaccard_join(frame(spark, texts, [None] * len(texts)).repartition(3)).collect()
    assert len(got) == len(texts) and {r["component_id"] for r in got} == {None}


def test_odd_tables(spark):
    assert J.jaccard_join(spark.createDataFrame([], DOCS)).collect() == []
    got = J.jaccard_join(frame(spark, ["a b", "A  b", None, "", "a b"], [3, 3, 7, 8, None])).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(3, 1, 3), (3, 1, 3), (7, 0, 7), (8, 0, 8), (None, 1, 3)], key=str)


def test_sifted_rows_hold_all_partners_and_little_else(spark):
    rows = spark.range(-5000, 15000).selectExpr("if(id = 0, null, id) as k", "id as helper0")
    wanted = spark.range(-50, 250).selectExpr("if(id = 0, null, id * 3) as w")
    got = sift(rows, "k", wanted, "w")
    assert got.columns == ["k", "helper0"]
    keys, want = [r["k"] for r in got.collect()], [r["w"] for r in wanted.collect()]
    assert len(keys) == len(set(keys)) < 320 and set(want) <= set(keys)
    assert sift(rows, "k", wanted.filter("w > 10000"), "w").isEmpty()
