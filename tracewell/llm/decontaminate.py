"""Benchmark decontamination: suffix arrays over shards of the training text, searched for every test suffix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._hash import Rolling, lower_ascii, ngram, word_spans
from ._util import batch_of, chunks, flat, small_batches

_INSIDE = np.ones(256, bool)
_INSIDE[:0x30] = _INSIDE[0x3A:0x61] = _INSIDE[0x7B:0x80] = False
#: A suffix whose first so many words begin no test suffix can't hold a match and stays out of a shard's array.
FIRST = 3

FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest_match", T.LongType()),
    T.StructField("matches", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]
_ARROW = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("longest_match", pa.int64()), ("matches", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, words before each document). Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Never 0."""
    data = lower_ascii(data)
    start, end, before = word_spans(data, ends, _INSIDE)
    return np.maximum(Rolling(data)(start, end), np.uint64(1)), before


def keys(w: np.ndarray, at: np.ndarray, length: np.ndarray, window: int, fill: int) -> np.ndarray:
    """Byte strings that sort as the word runs ``w[at : at + length]``, with ``fill`` for the words after them."""
    out = np.full((len(at), window), np.uint64(fill))
    for i in range(window):
        has = length > i
        out[has, i] = w[at[has] + i]
    return np.ascontiguousarray(out.astype(">u8")).view(f"S{8 * window}").ravel()


class TestSuffixes:
    """The windows of a block of items: each starts a suffix of its item."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window, self.names = window, [x[0] for x in items]
        data = [x[1].encode() for x in items]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        self.words, before = words(np.frombuffer(b"".join(data), np.uint8), ends)
        n = np.diff(before)
        starts = np.where(n >= window, n - window + 1, np.minimum(n, 1))
        self.item = np.repeat(np.arange(len(items)), starts)
        self.at = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts) + np.repeat(before[:-1], starts)
        self.length = np.minimum(n, window)[self.item]
        self.firsts = {k: np.unique(self._first(k)) for k in range(1, FIRST + 1)}

    def _first(self, k: int) -> np.ndarray:
        at = self.at[np.minimum(self.length, FIRST) == k]
        return ngram(self.words, k)[at] if len(at) else np.zeros(0, np.uint64)

    def search(self, w: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (test suffix, shard position, words matched) with a whole window; ``w``: the shard's words."""
        begin = np.zeros(len(w), bool)
        for k, known in self.firsts.items():
            if len(known) and len(w) >= k:
                begin[: len(w) - k + 1] |= np.isin(ngram(w, k), known)
        at = np.flatnonzero(begin)
        if not len(at):
            return (np.zeros(0, np.int64),) * 3
        left = before[np.searchsorted(before, at, side="right")] - at
        suffixes = keys(w, at, left, self.window, 0)
        order = np.argsort(suffixes, kind="stable")  # the shard's suffix array
        suffixes, at = suffixes[order], at[order]
        lo = np.searchsorted(suffixes, keys(self.words, self.at, self.length, self.window, 0), side="left")
        hi = np.searchsorted(suffixes, keys(self.words, self.at, self.length, self.window, 0xFFFFFFFFFFFFFFFF), side="right")
        n = hi - lo
        test = np.repeat(np.arange(len(n)), n)
        found = at[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        return test, found, self.length[test]


def longest(tests: TestSuffixes, test: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each hit, the words of the longest verbatim match that it begins or continues: hits on one diagonal join."""
    order = np.lexsort((at, at - tests.at[test], tests.item[test]))
    t, a, m = tests.at[test][order], at[order], length[order].copy()
    item = tests.item[test][order]
    new = np.ones(len(a), bool)
    new[1:] = (np.diff(a) != 1) | (np.diff(t) != 1) | (np.diff(item) != 0)
    run = np.cumsum(new) - 1
    size = np.bincount(run)
    out = np.empty(len(a), np.int64)
    out[order] = m + (size - 1)[run]
    return out


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items, longest_match (words) and matches (word ranges); columns of these names are replaced.

    A window is ``window`` consecutive words of an item, or all words of a shorter one; a document word inside any
    occurrence is hit. Each task builds suffix arrays over shards of its documents and binary-searches every test suffix
    in them. Items travel to the tasks in blocks of at most ``block_bytes`` of text, one in memory at a time, so a
    benchmark of any size can be searched, though each shard goes through all blocks. Words are compared by 64-bit hashes. Null text has no words; null item ids count as an empty name; repeated item
    ids count once; empty tables on either side give no hits; other columns pass through.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(*(f.name for f in FIELDS))
    names = docs.columns
    blocks, block, size = [], [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").filter("text is not null").toLocalIterator():
        block.append((row["i"], row["text"]))
        size += len(row["text"]) + 100
        if size >= block_bytes:
            blocks.append(spark.sparkContext.broadcast(TestSuffixes(block, window)))
            block, size = [], 0
    if block:
        blocks.append(spark.sparkContext.broadcast(TestSuffixes(block, window)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            w, before = words(*flat(batch.column(text_col)))
            n = batch.num_rows
            cover, best = np.zeros(len(w) + 1, np.int64), np.zeros(n, np.int64)
            items: list[set[str]] = [set() for _ in range(n)]
            for shared in blocks:
                tests = shared.value
                test, at, length = tests.search(w, before)
                if len(test):
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + length, -1)
                    doc = np.searchsorted(before, at, side="right") - 1
                    np.maximum.at(best, doc, longest(tests, test, at, length))
                    for pair in np.unique(doc * len(tests.names) + tests.item[test]):
                        items[pair // len(tests.names)].add(tests.names[pair % len(tests.names)])
                if len(blocks) > 1:  # read again when needed
                    del shared._value
            hit = np.cumsum(cover)[:-1] > 0
            sums = np.concatenate([[0], np.cumsum(hit)])
            matches: list[list[dict]] = [[] for _ in range(n)]
            for d in np.flatnonzero(best):
                own = np.flatnonzero(np.diff(np.concatenate([[0], hit[before[d] : before[d + 1]].view(np.int8), [0]])))
                matches[d] = [{"start": int(a), "end": int(b)} for a, b in zip(own[::2], own[1::2], strict=True)]
            more = batch_of(_ARROW, n_words=np.diff(before), n_hit=np.diff(sums[before]), n_items=[len(x) for x in items], items=[sorted(x) for x in items], longest_match=best, matches=matches)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + more.columns, [*names, *_ARROW.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *FIELDS]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a whole window of a benchmark item; same columns."""
    return scan(docs, benchmark, window, text_col).filter("n_hit = 0").select(*docs.columns)


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of a scan."""
    return scanned.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def sha256_of(names: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(set(names))).encode()).hexdigest()
