import random
import re

import pytest

from tests.llm.data import DOCS, awkward, frame
from tracewell.llm import decontaminate as D

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(texts, items, window=10):
    out = []
    for i, text in enumerate(texts):
        w, hit, found, best = split(text), set(), set(), 0
        for name, item in items:
            t = split(item)
            n = min(window, len(t))
            for a in range(len(t) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == t[a : a + n]:
                        hit |= set(range(p, p + n))
                        found.add(str("" if name is None else name))
                        m = n
                        while p + m < len(w) and a + m < len(t) and w[p + m] == t[a + m]:
                            m += 1
                        best = max(best, m)
        out.append((i, len(w), len(hit), len(found), D.sha256_of(found), bool(hit)))
    return out


def planted():
    rng = random.Random(4)
    vocab = [f"W{i}" for i in range(12)] + ["Élan", "x9", "the"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate([30, 14, 10, 9, 5, 3, 1, 0, 12])] + [(None, "lone unique phrase"), (20, None), (3, "again same id here"), (21, "--- !!")]
    texts = awkward()
    for _, item in items:
        for _ in range(2):
            w = [rng.choice(vocab) for _ in range(40)]
            w[rng.randint(0, 40) : 0] = (item or "").split()[: rng.randint(3, 40)]
            texts.append(", ".join(w).lower())
    return texts + ["w1 " * 60, "w1 w1"], items


@pytest.mark.parametrize("block", [8 << 20, 120])
def test_matches_brute_force(spark, block):
    texts, items = planted()
    table = spark.createDataFrame(items, "item_id long, text string")
    got = D.scan(frame(spark, texts).repartition(3), table, block_bytes=block)
    assert sorted(map(tuple, D.digest(got).collect())) == brute(texts, items)


def test_longest_match_is_verbatim(spark):
    item = " ".join(f"t{i}" for i in range(25))
    docs = frame(spark, ["x y " + item + " z", " ".join(item.split()[:17]), " ".join(item.split()[:9])])
    got = D.scan(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).orderBy("doc_id").collect()
    assert [r["longest_match"] for r in got] == [25, 17, 0]
    assert [[tuple(m) for m in r["matches"]] for r in got] == [[(2, 27)], [(0, 17)], []]


def test_removal_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = frame(spark, ["a one TWO three b", "clean", None, "clean"])
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]
    assert D.scan(spark.createDataFrame([], DOCS), items).collect() == []
    assert D.decontaminate(docs, items.limit(0)).count() == 4
