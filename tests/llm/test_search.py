import math
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.data import awkward, frame
from tracewell.llm import search as S

ITEMS = "item_id long, text string, score long, rank long"


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low))


def brute(docs, items, k=50):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t, sum(t.values())) for i, t in held if t]
    big_n, big_l = len(held), sum(n for *_, n in held)
    df = Counter(w for _, t, _ in held for w in t)
    out = []
    for item, text in items:
        scored = []
        for i, t, n in held:
            m = 50 + (50 * n * big_n) // big_l
            got = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * t[w]) // (1000 * t[w] + 20 * m)) for w in terms(text) if w in t)
            if got > 0:
                scored.append((-got, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "shard_postings"), [(50, 500), (3, 200), (5, 10**6)])
def test_matches_brute_force(spark, k, shard_postings):
    texts = awkward() + ["one hot copy of the gamma"] * 70
    docs = [((7 * i) % 1009, t) for i, t in enumerate(texts)] + [(None, texts[5]), (7, texts[5])]
    items = [(1, texts[4]), (2, "the ÜND und GAMMA copy the"), (3, "absent"), (4, None), (5, ""), (6, "7 x"), (7, "hot")]
    got = S.search(frame(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(3), spark.createDataFrame([(*x, 1, 2) for x in items], ITEMS), k, shard_postings=shard_postings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, k)


def test_empty_tables_and_repeated_items(spark):
    docs, items = frame(spark, ["a b", "b"]), spark.createDataFrame([(1, "b", 0, 0)] * 2 + [(1, "a", 0, 0)], ITEMS)
    assert S.search(docs.limit(0), items).collect() == [] and S.search(docs, items.limit(0)).collect() == []
    assert sorted((r["rank"], r["doc_id"]) for r in S.search(docs, items).collect()) == [(1, 0), (1, 1), (2, 0)]


def test_a_tree_skips_what_cannot_win():
    rng = np.random.default_rng(3)
    n = 4096
    doc, term = np.repeat(np.arange(n), 4), rng.integers(0, 60, 4 * n)
    pairs = np.unique(doc * 60 + term)
    doc, term, impact = pairs // 60, pairs % 60, rng.integers(1, 1000, len(pairs))
    impact[rng.integers(0, len(pairs), 20)] = 100_000
    tree = S.DualSortedTree(doc, term, impact, n)
    visited = []
    inner = tree.children
    tree.children = lambda *a: visited.append(len(a[0])) or inner(*a)
    asked, weights = np.array([3, 17, 99]), np.array([7, 5, 1])
    score = np.bincount(doc, (impact * ((term == 3) * 7 + (term == 17) * 5)), n).astype(int)
    want = sorted(((-s, d) for d, s in enumerate(score) if s > 0))[:5]
    at, got = tree.top(asked, weights, 5)
    assert list(zip(-got, at, strict=True)) == want and sum(visited) < n // 2
