import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.data import DOCS, awkward, frame
from tracewell.llm import suffix_dedup as S


def brute(texts, length=S.LENGTH):
    raw = [(t or "").encode() for t in texts]
    count = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for d, x in enumerate(raw):
        spans = S.unite([(i, i + length) for i in range(len(x) - length + 1) if count[x[i : i + length]] > 1])
        kept = bytes(b for i, b in enumerate(x) if not any(a <= i < e for a, e in spans))
        out.append((d, len(x), sum(e - a for a, e in spans), len(spans), S.sha256(kept)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.choice([30, 40, 50, 60, 90])) for _ in range(6)]
    exact = text(100)[: S.LENGTH]
    out = []
    for _ in range(25):
        parts = [text(rng.randint(1, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, 60)
            parts += [p[cut:] if rng.random() < 0.5 else p[: len(p) - cut], text(rng.randint(0, 20))]
        out.append(" ".join(parts))
    near = list(out[0])
    near[len(near) // 2] = "#"
    return out + ["".join(near), out[1], out[1], "be " * 150, "x be " * 100 + text(20), "y" * 450, "z" * 200, "z" * 199, "q" * 200, "k" + exact, exact + "j", "m" + exact[:-1] + "!", text(3) + exact[1:]]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    texts = corpus(seed) + awkward()
    got = S.digest(S.remove_repeats(frame(spark, texts).repartition(5)))
    assert sorted(map(tuple, got.collect())) == brute(texts)


def test_windows_have_the_anchors_of_their_content():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    data[1000:1400] = data[2500:2900]
    at, first, last, _ = S.anchors(data, np.array([2000, 4000]))
    of = {s: int(a) - s for a, f, e in zip(at, first, last, strict=True) for s in range(f, e + 1)}
    assert sorted(of) == [*range(1801), *range(2000, 3801)]
    assert all(of[1000 + i] == of[2500 + i] for i in range(201))


def test_loser_tree_merges_and_knows_common_prefixes():
    rng = random.Random(5)
    runs = [sorted("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(rng.randint(0, 40))) for _ in range(7)]
    coded = [S.Run.encode([(x, str(k).encode()) for x in run]) for k, run in enumerate(runs)]
    assert [x[1] for x in S.Run.decode(coded[0])] == runs[0]
    got = list(S.LoserTree([S.Run.decode(c) for c in coded]))
    assert [x[1] for x in got] == sorted(x for run in runs for x in run)
    for (_, a, _), (same, b, _) in zip(got, got[1:], strict=False):
        assert same == S.common(a, b, 0)


def test_odd_tables(spark):
    assert S.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []
    long = " ".join(str(i) for i in range(100))
    got = S.digest(S.remove_repeats(frame(spark, [long, long, long + "!", None], [5, 5, None, None]))).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("5", 289), ("5", 289), ("None", 0), ("None", 289)]
