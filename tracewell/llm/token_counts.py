"""Token counts of a unigram language model by dynamic programming over a trie of distinct pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import batch_of, small_batches

#: Pre-tokens that a worker remembers with their counts before it starts anew.
CACHED_WORDS = 600_000
#: The mark that opens a pre-token.
OPEN = "▁"

_models: dict[str, tuple[dict[str, float], int, float]] = {}
_known: dict[str, dict[str, int]] = {}


def vocabulary(path: str) -> tuple[dict[str, float], int, float]:
    """(log probability by piece, longest piece, log probability of a byte that no piece covers).

    The file ranks its pieces but has no unigram probabilities; rank r gets those of Zipf's law, 1 / (r + 1), normalised.
    Bytes have the probability of the last rank.
    """
    if path not in _models:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        total = math.log(sum(1 / (r + 1) for r in range(len(plain))))
        scores = {p: -math.log(r + 1) - total for r, p in reversed(list(enumerate(plain)))}
        _models[path] = scores, max(map(len, plain)), -math.log(len(plain)) - total
    return _models[path]


class Trie:
    """Distinct pre-tokens by shared prefix. ``children[node]`` maps a character to a node; a terminal keeps its word."""

    def __init__(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.terminal: list[str | None] = [None]

    def insert(self, word: str) -> None:
        node = 0
        for c in word:
            if (to := self.children[node].get(c)) is None:
                to = self.children[node][c] = len(self.children)
                self.children.append({})
                self.terminal.append(None)
            node = to
        self.terminal[node] = word

    def counts(self, scores: dict[str, float], longest: int, byte: float) -> dict[str, int]:
        """Tokens of the most probable segmentation of each word; forward scores are computed once a node.

        Of equally probable segmentations the one whose last piece is longer wins.
        """
        out: dict[str, int] = {}
        path: list[str] = []
        best, tokens = [0.0], [0]
        stack = [(0, 0, "")]
        while stack:
            node, depth, c = stack.pop()
            if depth:
                del path[depth - 1 :], best[depth:], tokens[depth:]
                path.append(c)
                tail = "".join(path[-longest:])
                size = len(c.encode("utf-8", "surrogatepass"))
                top, n = best[depth - 1] + byte * size, tokens[depth - 1] + size
                for k in range(1, len(tail) + 1):
                    if (s := scores.get(tail[-k:])) is not None and (new := best[depth - k] + s) >= top:
                        top, n = new, tokens[depth - k] + 1
                best.append(top)
                tokens.append(n)
                if (word := self.terminal[node]) is not None:
                    out[word] = n
            stack += [(to, depth + 1, x) for x, to in self.children[node].items()]
        return out


def count_words(words: Iterable[str], path: str) -> dict[str, int]:
    """Tokens by word; words not seen before go through a trie together, sorted so that prefixes meet."""
    known = _known.setdefault(path, {})
    distinct = set(words)
    new = sorted(distinct.difference(known))
    if new and len(known) > CACHED_WORDS:
        known.clear()
        new = sorted(distinct)
    for i in range(0, len(new), 50_000):  # bounds the trie
        trie = Trie()
        for w in new[i : i + 50_000]:
            trie.insert(OPEN + w)
        known.update((w[1:], n) for w, n in trie.counts(*vocabulary(path)).items())
    return known


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_tokens of the unigram model over the vocabulary file ``path``.

    Pre-tokens are the runs between white space, each opened by a mark. Null and empty texts have no words and no tokens;
    whole texts count; repeated rows and null ids are kept; an empty table gives an empty result; other columns are
    ignored. No row is shuffled: distinct pre-tokens are met per worker, which remembers a bounded number.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [(x or "").split() for x in batch.column("text").to_pylist()]
            distinct: set[str] = set()
            for words in split:
                distinct.update(words)
            known = count_words(distinct, path)
            yield batch_of(schema, doc_id=batch.column("doc_id"), n_words=np.array([len(x) for x in split], np.int64), n_tokens=np.array([sum(map(known.__getitem__, x)) for x in split], np.int64))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
