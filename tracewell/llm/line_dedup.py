"""Fuzzy line removal: MinHash over character shingles, high-recall banding, exact Jaccard, distributed union-find."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import MARKED, MARKS, link_all, marks, may_link, shared
from ._hash import Rolling, mix
from ._util import batch_of, chunks, discard, sift, small_batches, stash, unused

SHINGLE = 8
#: Lines are alike from this Jaccard similarity of their shingle sets.
SHARE = (4, 5)
ALIKE = SHARE[0] / SHARE[1]
#: 14 bands of 5 minima: two lines of similarity 0.8 share a band with probability 0.996, of 0.9 with 0.99999.
BANDS, ROWS = 14, 5
_EMPTY = np.uint64(1 << 32)


def lines(text: str | None) -> list[str]:
    """The lines of a text without white space at their ends; blank ones are empty strings."""
    return [x.strip() for x in (text or "").split("\n")]


def line_id(line: str) -> int:
    """A 64-bit name of the line, signed."""
    x = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of every shingle; lines ascend."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) for t in texts])
    ends = np.concatenate([[0], np.cumsum(size)])
    n = np.maximum(size - SHINGLE + 1, 1)
    line = np.repeat(np.arange(len(texts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + ends[line]
    return line, Rolling(codes)(at, np.minimum(at + SHINGLE, ends[line + 1]))


def signatures(texts: list[str]) -> np.ndarray:
    """One-permutation MinHash, BANDS * ROWS minima a line; empty bins borrow from others in an order that all lines share."""
    bins = BANDS * ROWS
    line, h = shingle_hashes(texts)
    out = np.full(len(texts) * bins, _EMPTY)
    np.minimum.at(out, line * bins + (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64), h & np.uint64(0xFFFFFFFF))
    out = out.reshape(-1, bins)
    own = out.copy()
    short = np.flatnonzero((out == _EMPTY).any(axis=1))
    attempt = 0
    while len(short):
        attempt += 1
        if attempt <= 60:
            source = (mix(np.arange(bins, dtype=np.uint64) * np.uint64(1000) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        else:  # very short lines: the next bin that has something
            source = (np.arange(bins) + attempt - 60) % bins
        out[short] = np.where(out[short] == _EMPTY, own[short][:, source], out[short])
        short = short[(out[short] == _EMPTY).any(axis=1)]
    return out


def band_keys(texts: list[str]) -> np.ndarray:
    """(lines, BANDS) 64-bit keys."""
    minima = signatures(texts).reshape(-1, BANDS, ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), minima.shape[:2]).copy()
    for r in range(ROWS):
        keys = mix(keys) + minima[:, :, r]
    return mix(keys)


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def _occurrences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per line that isn't blank, and one without a line per document."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("no", pa.int32()), ("line", pa.int64())])
    for batch in chunks(batches):
        rows: list[tuple] = []
        for d, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True):
            rows.append((d, h, -1, None))
            rows += [(d, h, k, line_id(x)) for k, x in enumerate(lines(text)) if x]
        yield batch_of(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))


def _bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])
    for batch in chunks(batches):
        own = list(dict.fromkeys(x for text in batch.column("text").to_pylist() for x in lines(text) if x))
        if own:
            yield batch_of(schema, key=band_keys(own).view(np.int64).ravel(), node=np.repeat(np.array([line_id(x) for x in own], np.int64), BANDS))


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("node", pa.int64()), ("text", pa.string())])
    for batch in chunks(batches):
        got: dict[int, str] = {}
        for text, nodes in zip(batch.column("text").to_pylist(), batch.column("nodes").to_pylist(), strict=True):
            wanted = set(nodes)
            got.update((n, x) for x in lines(text) if x and (n := line_id(x)) in wanted)
        yield batch_of(schema, node=list(got), text=list(got.values()))


def _mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with the size and the parity words of their hashed sets."""
    schema = pa.schema([("node", pa.int64()), ("text", pa.string()), ("size", pa.int32()), *((f"w{k}", pa.int64()) for k in range(MARKS))])
    for batch in chunks(batches):
        row, h = _features(batch.column("text"))
        odd = marks(row, h, batch.num_rows)
        yield batch_of(schema, node=batch.column("node"), text=batch.column("text"), size=np.bincount(row, minlength=batch.num_rows).astype(np.int32), **{f"w{k}": odd[:, k] for k in range(MARKS)})


def _hashed_sets(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values of a line's number above the upper bits of a shingle's hash, distinct shingles by line)."""
    line, h = shingle_hashes(texts)
    keys = np.sort((line.astype(np.uint64) << np.uint64(64 - bits)) | (h >> np.uint64(bits)))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return keys, np.bincount((keys >> np.uint64(64 - bits)).astype(np.int64), minlength=len(texts))


def alike(xs: list[str], ys: list[str]) -> list[int]:
    """The places at which the lines of both lists are alike: hashed sets screen the pairs, whole shingles decide."""
    if not xs:
        return []
    bits = len(xs).bit_length()
    (a, n), (b, m) = _hashed_sets(xs, bits), _hashed_sets(ys, bits)
    both = np.sort(np.concatenate([a, b]))
    both = both[1:][both[1:] == both[:-1]]
    common = np.bincount((both >> np.uint64(64 - bits)).astype(np.int64), minlength=len(xs))
    near = np.flatnonzero(common >= (ALIKE - 0.01) * (n + m - common))
    out = []
    last, t = None, set()
    for k in near.tolist():
        if ys[k] != last:  # pairs come by their second line
            last, t = ys[k], shingles(ys[k])
        s = shingles(xs[k])
        size = len(s & t)
        if size >= ALIKE * (len(s) + len(t) - size):
            out.append(k)
    return out


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in chunks(chunks(batches, "text_a"), "text_b"):
        keep = pa.array(alike(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()), pa.int64())
        yield batch_of(schema, a=batch.column("a").take(keep), b=batch.column("b").take(keep))


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of the distinct shingles, lines ascending."""
    line, h = shingle_hashes(texts.to_pylist())
    order = np.lexsort((h, line))
    line, h = line[order], h[order]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (h[1:] != h[:-1])
    return line[new], h[new]


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line that isn't blank, and one without a line per row: doc_id, text_hash, no, line, component, removed.

    Lines that are equal but for white space at their ends are one node; MinHash bands propose pairs of nodes, of which
    those with a Jaccard similarity of SHINGLE-character shingles of ALIKE or more are linked; where a band is crowded, its
    lines are compared by the rare shingles that they share, which misses none. Of each component the
    first line by (doc_id, text_hash, no) stays. A line shorter than SHINGLE is a shingle of its own. Null and blank texts have
    no lines; a null id comes first; rows that repeat an id with another text are documents of their own, and of rows that
    repeat both each keeps the lines that stay; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = stash(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_occurrences, "doc_id long, text_hash long, no int, line long"), "lines")
    members = stash(shared(docs.select("text").mapInArrow(_bands, "key long, node long")), "members")
    wanted = members.select("node").distinct()
    stands = seen.filter("line is not null").join(wanted, F.col("line") == F.col("node"), "left_semi").groupBy("line").agg(F.min("doc_id").alias("stand"))
    stands = stash(stands.groupBy("stand").agg(F.collect_list("line").alias("nodes")), "stands", tiny=True)  # at most the lines of one document
    texts = sift(docs, "doc_id", stands, "stand")
    texts = texts.join(stands, texts["doc_id"].eqNullSafe(stands["stand"])).select("text", "nodes").mapInArrow(_texts, "node long, text string")
    texts = stash(texts.dropDuplicates(["node"]).mapInArrow(_mark, f"node long, text string, size int, {MARKED}"), "texts")

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda x, n, w: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"), F.col("size").alias(n), *(F.col(f"w{k}").alias(f"{w}{k}") for k in range(MARKS)))
        near = F.expr(f"least(n, m) * {SHARE[1]} >= greatest(n, m) * {SHARE[0]}") & may_link("u", "v", "n", "m", SHARE)
        return pairs.join(side("a", "n", "u"), "a").join(side("b", "m", "v"), "b").filter(near).select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long")

    found = link_all(members, verify, texts, _features, SHARE)
    classed = seen.join(found, seen["line"] == found["id"], "left").select("doc_id", "text_hash", "no", "line", F.coalesce("component", "line").alias("component"))
    classed = stash(classed, "classes")
    discard(members, stands, texts, seen)
    kept = classed.filter("line is not null").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash", "no")).alias("first"), F.count(F.lit(1)).alias("size"))
    judged = classed.join(kept.filter("size > 1").select("component", "first"), "component", "left")
    removed = F.col("first").isNotNull() & ~F.struct("doc_id", "text_hash", "no").eqNullSafe(F.col("first"))
    return judged.select("doc_id", "text_hash", "no", "line", "component", removed.alias("removed"))


def line_report(classes: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_hash, n_lines (not blank), n_removed, removed (line numbers from 0, sorted)."""
    gone = F.sort_array(F.array_distinct(F.collect_list(F.when(F.col("removed"), F.col("no")))))
    copies = F.count(F.when(F.col("no") == -1, 1))  # rows that repeat the id and the text have the same lines
    found = classes.groupBy("doc_id", "text_hash").agg(copies.alias("copies"), F.count("line").alias("n"), gone.alias("removed"))
    return found.select("doc_id", "text_hash", F.expr("n div copies").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed")


def _rebuild(names: list[str], text_col: str, gone_col: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            for k, gone in enumerate(batch.column(gone_col).to_pylist()):
                if gone and texts[k] is not None:
                    off = set(gone)
                    texts[k] = "\n".join(x for no, x in enumerate(texts[k].split("\n")) if no not in off)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == text_col else batch.column(n) for n in names], names)

    return run


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines cut from their texts; documents, also ones left without text, and columns stay."""
    of, key, gone = unused(docs, 3)
    report = line_report(line_classes(docs, id_col, text_col)).filter("n_removed > 0").select(F.col("doc_id").alias(of), F.col("text_hash").alias(key), F.col("removed").alias(gone))
    same = docs[id_col].cast("long").eqNullSafe(report[of]) & (F.xxhash64(docs[text_col].cast("string")) == report[key])
    joined = docs.join(report, same, "left").drop(of, key)
    return joined.mapInArrow(_rebuild(docs.columns, text_col, gone), docs.schema)
