import random

import numpy as np

from tests.llm.data import DOCS, awkward, frame
from tracewell.llm import langid

SOUNDS = {"aa": "ka to mi ra nu se", "bb": "sch ung ein keit ver zw", "cc": "ção lho nha mente ões ir"}


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lang = rng.choice(list(SOUNDS))
        out.append((" ".join("".join(rng.choice(SOUNDS[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))), lang))
    return out


def test_held_out_accuracy_and_rejection():
    model = langid.fit(*map(list, zip(*corpus(300, 1), strict=True)))
    texts, labels = zip(*corpus(200, 2), strict=True)
    data = [t.lower().encode() for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    best, score = model.predict(np.frombuffer(b"".join(data), np.uint8), ends)
    assert np.mean([model.languages[k] == y for k, y in zip(best, labels, strict=True)]) > 0.98
    assert (score < model.threshold).mean() < 0.05 and (0 <= score).all() and (score <= 1).all()
    assert model.history[-1] < model.history[0]


def test_one_text_scores_alike_alone_and_among_others():
    model = langid.fit(*map(list, zip(*corpus(60, 1), strict=True)))
    data = [t.lower().encode() for t, _ in corpus(20, 3)] + [b"", b"x", b"ab", b"abc"]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    together = model.logits(np.frombuffer(b"".join(data), np.uint8), ends)[0]
    for x, row in zip(data, together, strict=True):
        mine = [model.table[langid.subwords(np.frombuffer(x, np.uint8), n, len(model.table))] for n in langid.ORDERS if len(x) >= n]
        mean = np.concatenate(mine).mean(axis=0) if mine else 0
        assert np.allclose(row, mean + model.bias)


def test_identify_keeps_columns_and_handles_odd_rows(spark):
    rows = corpus(80, 4)
    docs = spark.createDataFrame([(i, t, y, "x") for i, (t, y) in enumerate(rows)], "doc_id long, text string, lang string, lang_score string")
    model = langid.train(docs)
    texts = awkward()
    got = langid.identify(frame(spark, texts), model).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == texts
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in model.languages) == letters and (letters or (r["lang_pred"], r["lang_score"], r["lang_rejected"]) == ("und", 0.0, True))
    assert langid.identify(docs, model).columns == ["doc_id", "text", "lang", "lang_pred", "lang_score", "lang_rejected"]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    model = langid.train(empty)
    assert langid.identify(empty, model).collect() == []
    assert {r["lang_pred"] for r in langid.identify(frame(spark, ["a", None]), model).collect()} == {"und"}


def test_labels_of_held_out_rows_are_never_read(spark):
    docs = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(corpus(90, 5))], "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    spoiled = docs.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a, b = (langid.train(d.filter(~langid.held_out())) for d in (docs, spoiled))
    assert a.languages == b.languages and np.array_equal(a.table, b.table)
