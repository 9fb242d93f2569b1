import hashlib
import re

import pytest

from tests.llm.data import DOCS, awkward, frame
from tracewell.llm.exact_dedup import exact_dedup


def brute(rows):
    sha = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    groups = {}
    for i, t in rows:
        groups.setdefault(sha(t), []).append(i)
    return sorted((i, min(groups[sha(t)]), len(groups[sha(t)]), i == min(groups[sha(t)]), sha(t)) for i, t in rows)


@pytest.mark.parametrize("counters", [1, 2, 256])
def test_matches_brute_force(spark, counters):
    texts = awkward() + ["hot copy"] * 40 + ["warm copy", "warm  copy"] * 5
    ids = [(7 * i) % 1009 for i in range(len(texts))]
    got = exact_dedup(frame(spark, texts, ids).repartition(5), counters=counters)
    assert sorted(map(tuple, got.collect())) == brute(list(zip(ids, texts, strict=True)))


def test_empty_null_ids_and_repeats(spark):
    assert exact_dedup(spark.createDataFrame([], DOCS)).collect() == []
    got = sorted(map(tuple, exact_dedup(frame(spark, ["a", "a", "b", "c", "c"], [None, 3, None, 5, 5])).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert got == sorted([(None, 3, 2, False), (3, 3, 2, True), (None, None, 1, False), (5, 5, 2, True), (5, 5, 2, True)], key=str)
