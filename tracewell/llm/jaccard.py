"""Exact Jaccard join of word shingles through PartEnum signatures."""

from __future__ import annotations

import bisect
import functools
import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import link_all, shared
from ._hash import Rolling, lower_ascii, mix, ngram, word_spans
from ._util import batch_of, chunks, discard, flat, sift, small_batches, stash

_INSIDE = np.ones(256, bool)
_INSIDE[0x20] = _INSIDE[0x09:0x0E] = False
WORDS = 5
#: Two sets link when intersection / union is at least SHARE[0] / SHARE[1].
SHARE = (4, 5)
#: Up to this Hamming distance subsets of few partitions are enumerated; beyond it, single partitions are signatures.
ENUMERATED = {1: 3, 2: 5, 3: 6}
_C = np.uint64(0xD6E8FEB86659FD93)
_ALL = (1 << 64) - 1


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: WORDS consecutive words, or all of fewer."""
    data, ends = flat(column)
    data = lower_ascii(data)
    start, end, before = word_spans(data, ends, _INSIDE)
    words = Rolling(data)(start, end)
    grams = {n: ngram(words, n) if len(words) >= n else words[:0] for n in range(1, WORDS + 1)}
    out = []
    for a, b in zip(before[:-1], before[1:], strict=True):
        n = min(WORDS, b - a)
        out.append(np.unique(grams[n][a : b - n + 1]) if n else words[:0])
    return out


def set_id(s: np.ndarray) -> int:
    """A 64-bit name of the set; equal sets share it."""
    return int(mix(np.array([int(mix(s ^ _C).sum(dtype=np.uint64)) + len(s) & _ALL], np.uint64)).view(np.int64)[0])


@functools.lru_cache(maxsize=None)
def bands(limit: int) -> list[tuple[int, int]]:
    """Sizes in bands [low, high] such that linked sets lie in one band or in two neighbours."""
    out, low = [], 1
    while low <= limit:
        out.append((low, low * SHARE[1] // SHARE[0]))
        low = out[-1][1] + 1
    return out


@functools.lru_cache(maxsize=4096)
def scheme(number: int) -> tuple[int, int, int]:
    """(k, partitions, spare) for linked sets of bands ``number`` - 1 and ``number``.

    k bounds their Hamming distance: |x| + |y| - 2 |x and y| <= (|x| + |y|) / 9 for a Jaccard similarity of 0.8. Beyond
    ENUMERATED there are k + spare partitions, so linked sets agree in at least ``spare`` of them, and in one with content
    where either has fewer empty ones.
    """
    sizes = bands(1 << 40)[max(0, number - 1) : number + 1]
    low, first, last = sizes[0][0], sizes[0][1], sizes[-1][1]
    most = first + min(last, first * SHARE[1] // SHARE[0])
    k = most * (SHARE[1] - SHARE[0]) // (SHARE[1] + SHARE[0])
    if k in ENUMERATED or k < 1:
        return k, ENUMERATED.get(k, 0), 0
    empty = k * math.exp(-low / k)
    spare = 1 + math.ceil(empty + 4 * math.sqrt(empty))
    return k, k + spare, spare


def band_of(size: int) -> int:
    return bisect.bisect_left(bands(1 << 40), size, key=lambda x: x[1])


def signatures(s: np.ndarray, number: int) -> np.ndarray:
    """The PartEnum signatures of a set under one scheme, as 64-bit keys.

    Single-partition signatures leave out empty partitions, unless the set has so many that an agreeing partition with
    content isn't certain; then they are signatures like others.
    """
    k, parts, spare = scheme(number)
    if k < 1:
        return s[:0]
    salt = np.uint64((number + 1) * int(_C) & _ALL)
    where = ((mix(s + salt) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    content = np.zeros(parts, np.uint64)
    np.add.at(content, where.astype(np.int64), mix(s ^ salt))
    content = mix(content + np.bincount(where.astype(np.int64), minlength=parts).astype(np.uint64))
    if k in ENUMERATED:
        chosen = np.array(list(itertools.combinations(range(parts), parts - k)))
        keys = np.full(len(chosen), salt)
        for j in chosen.T:
            keys = mix(keys + j.astype(np.uint64)) ^ content[j]
        return mix(keys + salt)
    full = np.bincount(where.astype(np.int64), minlength=parts) > 0
    if parts - full.sum() > spare - 1:
        full[:] = True
    return mix(content[full] + np.flatnonzero(full).astype(np.uint64) * _C + salt)


def all_signatures(s: np.ndarray) -> list[np.ndarray]:
    """Signatures under the two schemes of the set's band: with the band below, and with the band above."""
    b = band_of(len(s))
    return [signatures(s, b), signatures(s, b + 1)]


def bitmap(s: np.ndarray) -> bytes:
    """A parity bit by hash for each of about as many bits as the set has shingles. The bits in which two sets differ are no
    more than the shingles in which they do, and a longer bitmap folds to a shorter one by xor of its halves."""
    bits = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    at = (mix(s + _C) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """A lower bound of the Hamming distance of two sets, from their bitmaps."""
    if len(x) < len(y):
        x, y = y, x
    a, n = int.from_bytes(x, "little"), 8 * len(x)
    while n > 8 * len(y):
        n //= 2
        a = (a >> n) ^ (a & ((1 << n) - 1))
    return (a ^ int.from_bytes(y, "little")).bit_count()


def _describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("bits", pa.binary())])
    for batch in chunks(batches):
        sets = shingle_sets(batch.column("text"))
        yield batch_of(schema, doc_id=batch.column("doc_id"), text_hash=batch.column("text_hash"), n_shingles=[len(s) for s in sets], node=[set_id(s) for s in sets], bits=[bitmap(s) for s in sets])


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])
    for batch in chunks(batches):
        own = {set_id(s): s for s in shingle_sets(batch.column("text")) if len(s)}
        keys = [np.concatenate(all_signatures(s)) for s in own.values()]
        if keys:
            yield batch_of(schema, key=np.concatenate(keys).view(np.int64), node=np.repeat(np.array(list(own), np.int64), [len(x) for x in keys]))


def _screen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose bitmaps allow a link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        n, m, x, y = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b"))
        keep = pa.array([k for k in range(len(n)) if differing(x[k], y[k]) * (SHARE[1] + SHARE[0]) <= (n[k] + m[k]) * (SHARE[1] - SHARE[0])], pa.int64())
        yield batch_of(schema, a=batch.column("a").take(keep), b=batch.column("b").take(keep))


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in chunks(chunks(batches, "text_a"), "text_b"):
        b = batch.column("b").to_pylist()
        firsts = {n: k for k, n in reversed(list(enumerate(b)))}
        known = dict(zip(firsts, shingle_sets(batch.column("text_b").take(list(firsts.values()))), strict=True))
        keep = []
        for k, s in enumerate(shingle_sets(batch.column("text_a"))):
            both = len(np.intersect1d(s, known[b[k]], assume_unique=True))
            if both * SHARE[1] >= SHARE[0] * (len(s) + len(known[b[k]]) - both):
                keep.append(k)
        yield batch_of(schema, a=batch.column("a").take(pa.array(keep, pa.int64())), b=batch.column("b").take(pa.array(keep, pa.int64())))


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, rows ascending."""
    sets = shingle_sets(texts)
    return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate([np.zeros(0, np.uint64), *sets])


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id of the links of Jaccard similarity 0.8 and more.

    Words are runs of other than ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z; a set holds the distinct shingles of WORDS
    words, a shorter text is one shingle. Equal sets are one node, so copies add no pairs. Bands of set sizes turn the
    threshold into a Hamming distance; PartEnum signatures make all linked nodes share a key. Members of crowded keys are
    parted by their rarest shingles, bitmaps then rule out pairs that differ in too much, and every link is verified over
    whole sets. Shingles are compared by 64-bit hashes throughout. Null and wordless texts have an empty set and link with
    nothing. A null id never is a component's id unless all its ids are null; repeated ids keep a row each; an empty table
    gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    rows = stash(hashed.mapInArrow(_describe, "doc_id long, text_hash long, n_shingles long, node long, bits binary"), "sets")
    members = stash(shared(docs.select("text").mapInArrow(_sign, "key long, node long")), "members")
    wanted = members.select("node").distinct()
    one = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("stand"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"))
    one = stash(one, "nodes")
    stands = one.select("node", F.col("stand.doc_id").alias("of"), F.col("stand.text_hash").alias("of_hash"))
    texts = sift(hashed, "text_hash", stands, "of_hash")
    texts = texts.join(stands, texts["text_hash"].eqNullSafe(stands["of_hash"]) & texts["doc_id"].eqNullSafe(stands["of"])).select("node", "text")
    texts = stash(texts.dropDuplicates(["node"]), "texts")

    def sides(pairs: DataFrame, of: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(of.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in of.columns if c != "node")), side)
        return pairs

    def verify(pairs: DataFrame) -> DataFrame:
        near = sides(pairs, one.select("node", "n", "bits")).mapInArrow(_screen, "a long, b long")
        return sides(near, texts).select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long")

    found = link_all(members, verify, texts, _features, SHARE)
    named = rows.join(found, rows["node"] == found["id"], "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component"))
    named = stash(named, "classes")
    discard(members, one, texts)
    # a wordless document is alone, whatever its id
    least = named.filter("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = named.filter("n_shingles > 0").join(least, "component").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(named.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
