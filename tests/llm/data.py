"""Small tables with the awkward cases that every operator must handle."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, size long, rank long, key string"


def frame(spark, texts, ids=None):
    """Documents with the given texts, and extra columns whose names operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "src", None if t is None else len(t), "x", 1, 2, "y") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def awkward(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    words = "the of and to in Alpha beta, gamma; delta\n épsilon zêta 7 42 +49 x@y.io 10.0.0.1 ünd là".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(25)]
    return [None, "", " \n\t ", "a", texts[0], texts[0], texts[1] + " ", texts[1].replace(" ", "\t "), " ".join(texts[:20]) * 12, "...", "日本語 テキスト", "\U0001f600 a@b.co", *texts]
