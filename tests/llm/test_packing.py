import random
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.data import DOCS, awkward, frame
from tracewell.llm import packing
from tracewell.llm.queries import tokenizer_file

WORDS = tokenizer_file("word_bpe_49k.json")


def check(rows, ids, capacity=2048):
    """Every id lies in exactly one piece; sequences are gapless and fit."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["length"] > 0
        part = np.asarray(own[r["start"] : r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, own in ids.items():
        at = 0
        for start, n in sorted(by_doc[d]):
            assert start == at
            at += n
        assert at == len(own)
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return sum(map(len, ids.values())) / (capacity * len(by_seq))


def test_pieces_match_the_tokenizer(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORDS)
    texts = [*awkward(), "odd\x1cspace \x1d", "It's 'tis don''t 12 ½ Ⅷ İSTANBUL ΟΔΟΣ é", "z" * 5000]
    got = packing.pack(frame(spark, texts).repartition(3), WORDS)
    check(got.collect(), {i: [*model.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)})


def test_words_match_the_tokenizer_whatever_their_letters():
    """Letters that change their number or their kind in normalising and lower-casing, beside marks."""
    from tokenizers import Tokenizer

    model, rng = Tokenizer.from_file(WORDS), np.random.default_rng(11)
    letters = [*"abzAZİıßẞΣσςΟŉǰΐﬁʼnÅÅéE", "e\u0301", "I\u0307", "\u0307", "\u1100\u1161", "가", "ʰ", "ª", "中", "\u0345", "𝐀", "Ⅷ", "½", "7"]
    marks = [*"!'.,-_#(\"", "'s", "'LL", "...", "…", "’", "\u200b", "\xa0", "<|"]
    texts = ["TEKNİK BİLGİ. SAHİBİ, TÜRKİYE"]
    for _ in range(4000):
        word = lambda: "".join(rng.choice(letters, rng.integers(0, 5))) + "".join(rng.choice(marks, rng.integers(0, 3)))
        texts.append(" ".join(word() + word() for _ in range(rng.integers(1, 5))))
    want = [np.array(e.ids, "<u4").tobytes() for e in model.encode_batch(texts, add_special_tokens=False)]
    wrong = [t for t, a, b in zip(texts, packing.encode(texts, WORDS), want, strict=True) if a != b]
    assert not wrong


def test_every_plain_character_in_context():
    from tokenizers import Tokenizer

    model, rng = Tokenizer.from_file(WORDS), np.random.default_rng(5)
    every = [chr(c) for c in range(0x20, 0x250)]
    texts = [f"{a}{c}{b} {c}{b} {a}{c}" for c in every for a, b in (("a", "b"), ("!", "x"), ("9", "."), ("İ", "é"))]
    texts += ["".join(rng.choice(every, rng.integers(1, 12))) for _ in range(20_000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in model.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, packing.encode(texts, WORDS), want, strict=True) if a != b] == []


def test_little_padding():
    rng = np.random.default_rng(3)
    lengths = np.minimum(2048, rng.lognormal(6.3, 0.9, 20_000).astype(int) + 1)
    classes = np.where(lengths <= 64, lengths, -(-lengths // 4) * 4)
    hist = {int(s): int(n) for s, n in zip(*np.unique(classes, return_counts=True), strict=True)}
    out = packing.plan(hist, 2048)
    used = defaultdict(int)
    for times, has in out:
        assert sum(s * a for s, a in has.items()) <= 2048
        for s, a in has.items():
            used[s] += times * a
    assert dict(used) == hist
    assert lengths.sum() / (2048 * sum(t for t, _ in out)) > 0.99


def test_pricing_is_an_exact_knapsack():
    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes = np.unique(rng.integers(1, 30, 6))
        value = rng.random(len(sizes))
        best = [0.0] * 61
        for c in range(1, 61):
            best[c] = max([best[c - 1], *(best[c - s] + v for s, v in zip(sizes, value, strict=True) if s <= c)])
        pricing = packing.Pricing(sizes, value, 60)
        column = pricing.column()
        assert pricing.best[60] == pytest.approx(best[60]) and column @ value == pytest.approx(best[60]) and column @ sizes <= 60
        for k, worth in enumerate(pricing.with_each()):
            assert pricing.column(k) @ value == pytest.approx(worth) and pricing.column(k)[k] >= 1


def test_column_generation_meets_the_known_optimum():
    # 3 + 3 + 4 fills 10: 20 of 3 and 10 of 4 need ten sequences
    patterns, used = packing.column_generation(np.array([3, 4]), np.array([20.0, 10.0]), 10, gap=0)
    assert used.sum() <= 10.5 and np.allclose(patterns.T @ used, [20, 10])


def test_empty_table_and_repeats(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), WORDS).collect() == []
    rows = packing.pack(frame(spark, ["same text"] * 30, [4] * 30), WORDS).collect()
    assert len(rows) == 30 and len({r["sequence_id"] for r in rows}) == 1 and len({r["offset"] for r in rows}) == 30


def test_pre_tokens_encoded_together_are_as_alone():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORDS)
    ending = packing._ending(model)
    words = sorted({w for k in range(1, packing.PLAIN) for w in packing._PARTS.findall(f"{chr(k)} a{chr(k)} {chr(k)}{chr(k)}'s".lower())} | {"i", "̇", "'", "''", "'s", "q" * 300} | {f"w{k}o{k}" for k in range(2 * packing.TOGETHER)})
    want = [packing._raw(model.encode(w, add_special_tokens=False).ids) for w in words]
    assert packing.encode_words(words, model, ending) == want
    assert packing.encode_words(words, model, np.ones(len(ending), bool)) == want  # ends that can't be told apart
    assert packing.encode_words(words, model, ending[:0]) == want and packing.encode_words([], model, ending) == []


def test_latin_texts_are_parted_like_others():
    rng = random.Random(31)
    signs = [chr(c) for c in range(256)] + list("aeé' ") * 30
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(3000)] + ["'S it'll ÀÉ ½²³ µß", "a<|b", "x\x85y", "ǅ Ɓ", "é é"]
    for t in texts:
        assert packing.parts(t) == (None if packing._ODD.search(t) else packing._PARTS.findall(unicodedata.normalize("NFC", t).lower()))
    assert sum(packing.parts(t) is not None for t in texts) > 1000
