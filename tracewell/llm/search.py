"""Ranked lexical search over dual-sorted wavelet trees, one tree a shard.

A shard's postings lie list after list, each by falling impact, as a sequence of document numbers. A wavelet tree over that
sequence halves the range of documents at every level and keeps the order of a list within each node: a list's part in a
node is a range of positions, its first posting has the largest impact there, and the sum of these bounds what any document
of the node can score. Nodes are expanded best first until none can beat the k-th document found.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._hash import Rolling, lower_ascii, word_spans
from ._util import batch_of, chunks, discard, flat, small_batches, stash, tidy

#: Postings of a shard on average, and nodes that one step expands.
SHARD_POSTINGS, STEP = 500_000, 64

#: Bytes inside a term: digits, letters (A-Z count as a-z) and all of characters from U+0080 on.
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_VECTOR = "n long, terms array<bigint>, tfs array<bigint>"
NO_ID = np.iinfo(np.int64).max


def term_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "doc_id") -> DataFrame:
    """(id, n, terms, tfs): how many terms with repeats each row's text has, its distinct terms as 64-bit hashes, and how often
    each occurs. No row is shuffled, and a text of any length is read whole."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias(name), F.col(text_col).cast("string").alias("text"))
    kind = source.schema[name].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches):
            data, ends = flat(piece.column("text"))
            low = lower_ascii(data)
            starts, stops, before = word_spans(low, ends, INSIDE)
            vocabulary, which = np.unique(Rolling(low)(starts, stops), return_inverse=True)
            doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
            pairs, tf = np.unique(doc * max(1, len(vocabulary)) + which, return_counts=True)
            at = np.searchsorted(pairs, np.arange(len(before)) * max(1, len(vocabulary))).astype(np.int32)
            terms = vocabulary[pairs % max(1, len(vocabulary))].view(np.int64)
            yield pa.RecordBatch.from_arrays([piece.column(name), pa.array(np.diff(before).astype(np.int64)), pa.ListArray.from_arrays(at, pa.array(terms)), pa.ListArray.from_arrays(at, pa.array(tf.astype(np.int64)))], [name, "n", "terms", "tfs"])
        tidy()

    return source.mapInArrow(run, f"`{name}` {kind}, {_VECTOR}")


class DualSortedTree:
    """The index of one shard: documents by number, postings as ``doc``, ``term`` and ``impact`` arrays."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int):
        self.height = max(1, int(n_docs - 1).bit_length())
        self.terms, number = np.unique(term, return_inverse=True)
        order = np.lexsort((doc, -impact, number))
        sequence, held = doc[order].astype(np.int32), impact[order].astype(np.int32)
        self.lists = np.searchsorted(number[order], np.arange(len(self.terms) + 1))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=1 << self.height))))  # postings of documents before
        self.ones = np.zeros((self.height, len(doc) + 1), np.int32)
        self.impact = np.zeros((self.height + 1, len(doc) + 1), np.int32)
        for level in range(self.height + 1):
            nodes = sequence >> (self.height - level)
            by_node = np.argsort(nodes.astype(np.uint16) if level <= 16 else nodes, kind="stable")
            sequence, held = sequence[by_node], held[by_node]
            self.impact[level, :-1] = held
            if level < self.height:
                np.cumsum((sequence >> (self.height - 1 - level)) & 1, out=self.ones[level, 1:])

    def children(self, level: np.ndarray, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        """Both halves of nodes: their levels, numbers, and the ranges that the lists keep in them."""
        span = self.height - level
        begin, end = self.first[node << span], self.first[(node + 1) << span]
        row, base = level[:, None], self.ones[level, begin]
        right = begin + (end - begin) - (self.ones[level, end] - base)  # where the right half begins
        up_lo, up_hi = self.ones[row, lo] - base[:, None], self.ones[row, hi] - base[:, None]
        ranges = ((lo - up_lo, hi - up_hi), (right[:, None] + up_lo, right[:, None] + up_hi))
        return np.concatenate((level + 1, level + 1)), np.concatenate((2 * node, 2 * node + 1)), np.concatenate((ranges[0][0], ranges[1][0])), np.concatenate((ranges[0][1], ranges[1][1]))

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int = 0, before: int = NO_ID) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the ``k`` best, largest first, of equal ones the first; only such as score more than
        ``least``, or as much and have a number under ``before``."""
        at = np.searchsorted(self.terms, terms)
        held = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms) & (weights > 0)
        at, weights = at[held], weights[held]
        found_doc, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        level, node = np.zeros(1, np.int64), np.zeros(1, np.int64)
        lo, hi = self.lists[at][None, :], self.lists[at + 1][None, :]
        bound = np.array([NO_ID])
        while len(level) and len(at):
            if len(level) > STEP:
                best = np.argpartition(-bound, STEP - 1)[:STEP]
                rest = np.ones(len(level), bool)
                rest[best] = False
            else:
                best, rest = np.arange(len(level)), np.zeros(len(level), bool)
            lv, nd, a, b = self.children(level[best], node[best], lo[best], hi[best])
            bd = (np.where(a < b, self.impact[lv[:, None], a], 0) * weights).sum(1)
            level, node, lo, hi, bound = (np.concatenate((old[rest], new)) for old, new in ((level, lv), (node, nd), (lo, a), (hi, b), (bound, bd)))
            leaf = (level == self.height) & (bound > 0)
            if leaf.any():
                found_doc, found = np.concatenate((found_doc, node[leaf])), np.concatenate((found, bound[leaf]))
                keep = np.lexsort((found_doc, -found))[:k]
                found_doc, found = found_doc[keep], found[keep]
                if len(found) == k and (found[-1] > least or found[-1] == least and found_doc[-1] < before):
                    least, before = int(found[-1]), int(found_doc[-1])
            alive = (level < self.height) & ((bound > least) | ((bound == least) & (bound > 0) & (node << (self.height - level) < before)))
            level, node, lo, hi, bound = level[alive], node[alive], lo[alive], hi[alive], bound[alive]
        good = (found > least) | ((found == least) & (found_doc <= before))
        return found_doc[good], found[good]


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurrence count in a text of ``n`` terms is worth, in 64-bit integers."""
    m = 50 + (50 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` documents of the largest scores over 0, equal ones by rising id.

    Documents become vectors of terms, written once. Document frequencies are counted with a combining step and joined to the
    items' terms; documents are dealt to shards of about ``shard_postings`` postings, and every shard meets every item, one at
    a time, in the task that built its tree. Of a shard only its best ``k`` go on, and a task carries each item's bound from
    shard to shard. Terms are told apart by 64-bit hashes.

    Null text has no terms. Rows that repeat an id are documents of their own. A null id comes after all others of an equal
    score. Items that share an id but not their terms are queries of their own, each with ranks from 1; equal items count
    once; an item without terms that occur has no rows; empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    vectors = stash(term_vectors(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col), "search-vectors")
    with_terms, n_terms, postings = (int(x or 0) for x in vectors.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.size("terms"))).first())
    asked = term_vectors(items, item_col, item_text, "item_id").select("item_id", F.array_sort("terms").alias("terms")).distinct().withColumn("query", F.xxhash64(F.col("item_id").cast("string"), "terms"))
    wanted = asked.select("item_id", "query", F.explode("terms").alias("term"))
    seen = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(with_terms).cast("double") + 2) / (2 * F.col("df").cast("double") + 1))).cast("long")
    weighted = wanted.join(seen, "term").withColumn("weight", weight).groupBy("item_id", "query").agg(F.collect_list(F.struct("term", "weight")).alias("x"))
    queries = stash(weighted.select("item_id", "query", F.col("x.term").alias("terms"), F.col("x.weight").alias("vals")), "search-queries", tiny=True)
    shards = max(1, -(-postings // shard_postings))
    kind = queries.schema["item_id"].dataType
    rows = vectors.filter("n > 0").select(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("side"), "doc_id", "n", "terms", F.col("tfs").alias("vals"), F.lit(None).cast(kind).alias("item_id"), F.lit(None).cast("long").alias("query"))
    every = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n"), "terms", "vals", "item_id", "query")
    met = rows.unionByName(every).repartition("shard").sortWithinPartitions("shard", "side", F.asc_nulls_last("doc_id"))
    best = met.mapInArrow(shard_search(k, with_terms, n_terms), f"item_id {kind.simpleString()}, query long, doc_id long, score long")
    ranked = stash(best, "search-best")
    discard(vectors, queries)
    rank = F.row_number().over(Window.partitionBy("item_id", "query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def shard_search(k: int, with_terms: int, n_terms: int):
    """For ``mapInArrow`` over rows in the order of shards, in each the documents by id and then the items: builds the tree of a
    shard when its first item comes."""

    def lists(batch: pa.RecordBatch, rows: np.ndarray, column: str) -> tuple[np.ndarray, np.ndarray]:
        part = batch.column(column).take(pa.array(rows))
        return part.flatten().to_numpy(), np.diff(part.offsets.to_numpy())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        bounds: dict[int, tuple[int, int]] = {}  # what a document must beat: the k-th score and id of one of the shards before
        shard, docs, tree = -1, [], None
        for batch in batches:
            number, side = (batch.column(c).to_numpy() for c in ("shard", "side"))
            out: list[tuple[int, np.ndarray, np.ndarray]] = []
            cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(side) != 0)) + 1
            for rows in np.split(np.arange(batch.num_rows), cuts):
                if not len(rows):
                    continue
                if number[rows[0]] != shard:
                    shard, docs, tree = number[rows[0]], [], None
                if not side[rows[0]]:
                    terms, size = lists(batch, rows, "terms")
                    tf, _ = lists(batch, rows, "vals")
                    n = batch.column("n").to_numpy(zero_copy_only=False)[rows]
                    docs.append((batch.column("doc_id").fill_null(NO_ID).to_numpy()[rows], size, terms, impacts(tf, np.repeat(n, size), with_terms, n_terms)))
                    continue
                if tree is None and docs:
                    ids, size, terms, worth = (np.concatenate(x) for x in zip(*docs, strict=True))
                    docs = []
                    tree = DualSortedTree(np.repeat(np.arange(len(ids)), size), terms, worth, len(ids))
                    del size, terms, worth
                if tree is None:
                    continue
                key = batch.column("query").to_numpy(zero_copy_only=False)
                for row in rows.tolist():
                    one = np.array([row])
                    terms, _ = lists(batch, one, "terms")
                    weights, _ = lists(batch, one, "vals")
                    least, last = bounds.get(int(key[row]), (0, 0))
                    found, score = tree.top(terms, weights, k, least, int(np.searchsorted(ids, last)))
                    if len(found) == k:
                        bounds[int(key[row])] = int(score[-1]), int(ids[found[-1]])
                    if len(found):
                        out.append((row, ids[found], score))
            if out:
                schema = schema or pa.schema([batch.schema.field("item_id"), ("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
                rows = pa.array(np.repeat([r for r, _, _ in out], [len(d) for _, d, _ in out]))
                at = np.concatenate([d for _, d, _ in out])
                yield batch_of(schema, item_id=batch.column("item_id").take(rows), query=batch.column("query").take(rows), doc_id=pa.array(at, mask=at == NO_ID), score=np.concatenate([s for _, _, s in out]))
        tidy()

    return run
