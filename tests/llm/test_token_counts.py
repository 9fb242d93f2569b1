import random

from tests.llm.data import DOCS, awkward, frame
from tracewell.llm import token_counts as C
from tracewell.llm.queries import tokenizer_file

PIECES = tokenizer_file("piece_bpe_32k.model")


def brute(word, scores, longest, byte):
    """Best segmentation of one word by plain Viterbi."""
    best = [(0.0, 0)] + [None] * len(word)
    for i in range(1, len(word) + 1):
        n = len(word[i - 1].encode())
        top = (best[i - 1][0] + byte * n, best[i - 1][1] + n)
        for k in range(1, min(i, longest) + 1):
            if (s := scores.get(word[i - k : i])) is not None and best[i - k][0] + s >= top[0]:
                top = (best[i - k][0] + s, best[i - k][1] + 1)
        best[i] = top
    return best[-1][1]


def test_trie_scores_match_plain_viterbi():
    model = C.vocabulary(PIECES)
    rng = random.Random(2)
    words = {w for t in awkward() if t for w in t.split()} | {"".join(rng.choice("theandrongé日") for _ in range(rng.randint(1, 30))) for _ in range(800)}
    known = C.count_words(words, PIECES)
    assert {w: known[w] for w in words} == {w: brute(C.OPEN + w, *model) for w in words}


def test_forward_scores_are_shared_by_prefix():
    trie = C.Trie()
    for w in ("inter", "internal", "international", "interval"):
        trie.insert(w)
    assert len(trie.children) == 1 + len("international") + len("l") + len("val")


def test_rows_and_odd_cases(spark):
    texts = awkward() + ["q" * 30_000]
    got = sorted(map(tuple, C.count_tokens(frame(spark, texts), PIECES).collect()))
    model = C.vocabulary(PIECES)
    assert got == [(i, len((t or "").split()), sum(brute(C.OPEN + w, *model) for w in (t or "").split())) for i, t in enumerate(texts)]
    assert C.count_tokens(spark.createDataFrame([], DOCS), PIECES).collect() == []
