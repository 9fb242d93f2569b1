import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.data import awkward, frame
from tracewell.llm import resample as R


def grams(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, items):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for _, x in rows for f in grams(x)[1]) for rows in (docs, items))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    rows = []
    for i, x in docs:
        words, found = grams(x)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): k for k, r in enumerate(fit[: 5 * len(fit) // 100], 1)}
    return sorted(((*r[:4], drawn.get(id(r))) for r in rows), key=repr)


def test_matches_brute_force(spark):
    texts = awkward() + [f"{t} {k}" for k in range(4) for t in awkward(k + 2)[-25:]] + ["very the same words " * 9] * 20
    docs = [((7 * i) % 1009, t) for i, t in enumerate(texts)] + [(None, texts[5])]
    items = [(k, t) for k, t in enumerate(awkward(9)[-6:])] + [(9, None)]
    target = spark.createDataFrame(items, "item_id long, text string")
    got = R.resample(frame(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(3), target)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and dict(got.dtypes)["rank"] == "bigint"
    have = sorted(map(tuple, got.collect()), key=repr)
    assert have == brute(docs, items) and sum(r[4] is not None for r in have) == 5 * sum(len(grams(t)[0]) >= 20 for t in texts + [texts[5]]) // 100 > 3


@pytest.mark.parametrize("slices", [1, 7])
def test_packed_features_come_back(slices):
    texts = [*awkward(4), "a a a a b a a", "x"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    made = R.Words(batch)
    want = Counter(f for t in texts for f in grams(t)[1])
    got, totals = Counter(), np.zeros(R.BUCKETS, np.int64)
    for to in range(slices):
        known = R.Dictionary(totals)
        for slice_, n, size, body in made.packed(slices):
            if slice_ == to:
                names, counts, text, begins, sizes = R.unpack(n, size, body)
                got.update({b"".join(text[i : i + k].tobytes() for i, k in zip(b, s)).decode()[:-1]: int(c) for b, s, c in zip(begins, sizes, counts)})
                known.add(names, counts, text, begins, sizes)
                known.merge()
                known.add(names, counts * 2, text, begins, sizes)
        known.merge()
    assert got == want
    assert totals.sum() == 3 * sum(want.values()) and all(totals[zlib.crc32(f.encode()) % R.BUCKETS] >= 3 * c for f, c in want.items())


def test_checksums_of_runs_follow_from_those_of_words():
    texts = ["a bb ccc " + "x" * 64 + " " + "y" * 65 + " é7 " + "z" * 300 + " d", "", "one", *awkward(6)[4:9]]
    words = R.Words(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]))
    for n in (1, 2, 3):
        doc, crc = words.hashes(n)
        want = [(k, zlib.crc32(" ".join(w[i : i + n]).encode())) for k, t in enumerate(texts) for w in [grams(t)[0]] for i in range(len(w) - n + 1)]
        assert list(zip(doc.tolist(), crc.tolist(), strict=True)) == want


def test_a_vocabulary_too_large_for_one_number(monkeypatch):
    words = R.Words(pa.RecordBatch.from_arrays([pa.array(awkward(3)[4:9])], ["text"]))
    want = words.distinct_runs()
    words.hash = range(1 << 30)  # only its length counts here
    got = words.distinct_runs()
    assert all((a == b).all() for a, b in zip(got, want, strict=True))


def test_empty_tables(spark):
    docs, target = frame(spark, ["a b c", None]), spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert R.resample(docs.limit(0), target).collect() == []
    assert sorted(tuple(r)[:2] for r in R.resample(docs, target.limit(0)).collect()) == [(0, 6), (1, 0)]
