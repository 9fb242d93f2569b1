"""Removal of byte strings that occur more than once: a sparse suffix array built by a common-prefix-aware merge sort.

Every 200-byte window has an anchor, the leftmost of its 16-byte strings with the smallest hash, which depends on the
window's content alone. A run of windows with one anchor is a block: the suffix from the anchor on, and the bytes before
it backwards. Blocks whose anchor string occurs once in the corpus can't hold a repeated window and are dropped. The other
blocks are sorted locally, front-coded, dealt by anchor string, and merged by loser trees that keep the length of the
common prefix with the last winner and so never compare known prefixes again. Neighbours in the merged order tell which
windows can repeat; those are compared as whole 200-byte strings.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._hash import Rolling
from ._util import batch_of, chunks, discard, flat, small_batches, stash

LENGTH, ANCHOR = 200, 16
#: Text that one merge handles, about; fixes the number of merges.
MERGE_BYTES = 2 << 20


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, hash of the anchor's string) of each block; positions in ``data``."""
    n = len(data) - ANCHOR + 1
    if n < length - ANCHOR + 1:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    at = np.arange(n)
    h = Rolling(data)(at, at + ANCHOR)
    low = (h >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    width, span = length - ANCHOR + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    where = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # by window start
    doc = np.searchsorted(ends, np.arange(len(where)), side="right")
    whole = np.arange(len(where)) + length <= ends[np.minimum(doc, len(ends) - 1)]
    starts = np.flatnonzero(whole)
    where, doc = where[starts], doc[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(where) != 0) | (np.diff(doc) != 0) | (np.diff(starts) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    return where[first], starts[first], starts[last], h[where[first]]


class Run:
    """A sorted run of (string, payload) as bytes: strings front-coded against their predecessors."""

    @staticmethod
    def encode(entries: list[tuple[bytes, bytes]]) -> bytes:
        out, before = [], b""
        for text, payload in entries:
            same = common(before, text, 0)
            out.append(struct.pack("<HHI", same, len(text) - same, len(payload)) + text[same:] + payload)
            before = text
        return b"".join(out)

    @staticmethod
    def decode(raw: bytes) -> Iterator[tuple[int, bytes, bytes]]:
        """(common prefix with the one before, string, payload)."""
        at, before = 0, b""
        while at < len(raw):
            same, more, size = struct.unpack_from("<HHI", raw, at)
            at += 8
            before = before[:same] + raw[at : at + more]
            yield same, before, raw[at + more : at + more + size]
            at += more + size


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, given that the first ``known`` bytes agree."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step = known
    while True:  # doubling, then halving
        size = 8
        while a[step : step + size] == b[step : step + size]:
            step += size
            size *= 2
        if size == 8:
            while a[step] == b[step]:
                step += 1
            return step


class LoserTree:
    """Merges sorted runs. A node keeps the loser of its match and its common prefix with the winner that passed last;
    of two, the one that shares more with the last output is smaller, and only equal prefixes are compared further."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes, bytes]]]):
        self.runs = runs
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.head: list[tuple[bytes, bytes] | None] = [None] * self.size
        self.losers: list[tuple[int, int]] = [(-1, 0)] * self.size
        lcps = [0] * self.size
        for k, run in enumerate(runs):
            if (x := next(run, None)) is not None:
                self.head[k] = x[1:]
        level = [(k, lcps[k]) for k in range(self.size)]
        node = self.size
        while len(level) > 1:
            node //= 2
            nxt = []
            for i in range(0, len(level), 2):
                win, lose = self._match(level[i], level[i + 1])
                self.losers[node + i // 2] = lose
                nxt.append(win)
            level = nxt
        self.winner = level[0]

    def _match(self, a: tuple[int, int], b: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """(winner, loser), each (run, common prefix); the loser's is then with the winner."""
        x, y = self.head[a[0]], self.head[b[0]]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if a[1] != b[1]:
            return (a, b) if a[1] > b[1] else (b, a)
        same = common(x[0], y[0], a[1])
        if x[0][same : same + 1] <= y[0][same : same + 1]:
            return a, (b[0], same)
        return b, (a[0], same)

    def __iter__(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(common prefix with the output before, string, payload) in order."""
        while (now := self.head[self.winner[0]]) is not None:
            k, same = self.winner
            yield same, *now
            entry = (k, 0)
            if (x := next(self.runs[k], None)) is None:
                self.head[k] = None
            else:
                self.head[k], entry = x[1:], (k, x[0])
            node = (self.size + k) // 2
            while node:
                entry, self.losers[node] = self._match(entry, self.losers[node])
                node //= 2
            self.winner = entry


#: A payload holds the occurrences of a block: document id, 1 if the id is null, hash of the text, first window.
_OCCURRENCE = "<qBqq"


def _find_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("block", pa.int32())])
    for batch in chunks(batches):
        data, ends = flat(batch.column("text"))
        at, first, _, h = anchors(data, ends[1:])
        doc = np.searchsorted(ends, first, side="right") - 1
        block = np.arange(len(at)) - np.searchsorted(doc, doc)
        take = pa.array(doc)
        yield batch_of(schema, anchor=h.view(np.int64), doc_id=batch.column("doc_id").take(take), text_hash=batch.column("text_hash").take(take), block=block)


def _runs(merges: int):
    """For ``mapInArrow``: the candidate blocks of the joined documents as sorted front-coded runs, one per chunk and merge."""
    schema = pa.schema([("merge", pa.int32()), ("run", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, ends = flat(batch.column("text"))
            at, first, last, h = anchors(data, ends[1:])
            doc = np.searchsorted(ends, first, side="right") - 1
            from_doc = np.searchsorted(doc, np.arange(batch.num_rows))
            ids, hashes = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
            raw, made = data.tobytes(), {}
            for d, blocks in enumerate(batch.column("blocks").to_pylist()):
                name = (0 if ids[d] is None else ids[d], ids[d] is None, hashes[d])
                for k in from_doc[d] + np.array(sorted(blocks)):
                    a, lo, hi = int(at[k]), int(first[k]), int(last[k])
                    text = raw[a : hi + LENGTH] + raw[lo:a][::-1]
                    # equal blocks also agree in where their anchor lies
                    own = made.setdefault(int(h[k] >> np.uint64(16)) % merges, {})
                    own.setdefault((text, a - lo), []).append(struct.pack(_OCCURRENCE, *name, lo - int(ends[d])))
            rows = [(m, Run.encode([(text, struct.pack("<H", left) + b"".join(where)) for (text, left), where in sorted(own.items())])) for m, own in made.items()]
            yield batch_of(schema, merge=[r[0] for r in rows], run=[r[1] for r in rows])

    return run


def repeated(strings: list[bytes], lefts: list[int], counts: list[int], shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """(block, from, to) of the windows of sorted distinct blocks that occur more than once, by offset in the block.

    ``shared``: the common prefix with the block before. A window that starts ``a`` bytes before the anchor takes
    LENGTH - a bytes from the suffix, so it can only repeat in another block that shares as many.
    """
    n = len(strings)
    most = [max(shared[i], shared[i + 1] if i + 1 < n else 0) for i in range(n)]
    parts, owner, offset = [], [], []
    at = 0
    starts = []
    for i in range(n):
        windows = len(strings[i]) - LENGTH + 1
        if counts[i] > 1:
            yield i, 0, windows
        # block offset o is a = left - o
        to = min(windows, lefts[i] - (LENGTH - most[i]) + 1)
        if to > 0:
            left = lefts[i]
            parts.append(strings[i][len(strings[i]) - left :][::-1] + strings[i][: len(strings[i]) - left])
            owner.append(np.full(to, i))
            offset.append(np.arange(to))
            starts.append(at + np.arange(to))
            at += len(strings[i])
    if not parts:
        return
    data = np.frombuffer(b"".join(parts), np.uint8)
    start, owner, offset = np.concatenate(starts), np.concatenate(owner), np.concatenate(offset)
    h = Rolling(data)(start, start + LENGTH)
    order = np.argsort(h, kind="stable")
    again = np.zeros(len(h), bool)
    same = h[order][1:] == h[order][:-1]
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    keep = np.flatnonzero(again)
    if not len(keep):
        return
    new = np.ones(len(keep), bool)
    new[1:] = (np.diff(keep) != 1) | (np.diff(owner[keep]) != 0)
    begin = np.flatnonzero(new)
    for b, e in zip(begin, np.append(begin[1:], len(keep)), strict=True):
        yield int(owner[keep[b]]), int(offset[keep[b]]), int(offset[keep[e - 1]]) + 1


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by merge. Out: byte ranges to remove by document."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def finish(runs: list[bytes]) -> pa.RecordBatch:
        strings: list[bytes] = []
        lefts: list[int] = []
        shared: list[int] = []
        where: list[list[bytes]] = []
        low = 0
        for same, text, payload in LoserTree([Run.decode(r) for r in runs]):
            left = struct.unpack_from("<H", payload)[0]
            low = min(low, same)
            if strings and text == strings[-1] and left == lefts[-1]:
                where[-1].append(payload[2:])
                low = len(text)
                continue
            shared.append(low if strings else 0)
            strings.append(text)
            lefts.append(left)
            where.append([payload[2:]])
            low = len(text)
        rows: list[tuple] = []
        spots = [b"".join(x) for x in where]
        for i, a, b in repeated(strings, lefts, [len(x) // struct.calcsize(_OCCURRENCE) for x in spots], shared):
            rows += [(None if null else d, h, first + a, first + b - 1 + LENGTH) for d, null, h, first in struct.iter_unpack(_OCCURRENCE, spots[i])]
        return batch_of(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True))) if rows else pa.RecordBatch.from_pylist([], schema)

    now, runs = None, []
    for batch in batches:
        for m, raw in zip(batch.column("merge").to_pylist(), batch.column("run").to_pylist(), strict=True):
            if m != now and runs:
                yield finish(runs)
                runs = []
            now = m
            runs.append(raw)
    if runs:
        yield finish(runs)


def unite(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint ranges; ones that touch join."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", spans_type), ("kept", pa.binary())])
    for batch in chunks(batches):
        data, ends = flat(batch.column("text"))
        raw, removed, kept = data.tobytes(), [], []
        for d, found in enumerate(batch.column("ranges").to_pylist()):
            own, at, spans = raw[ends[d] : ends[d + 1]], 0, unite([(x["start"], x["end"]) for x in found or []])
            parts = []
            for a, b in spans:
                parts.append(own[at:a])
                at = b
            removed.append([{"start": a, "end": b} for a, b in spans])
            kept.append(b"".join([*parts, own[at:]]))
        yield batch_of(schema, doc_id=batch.column("doc_id"), n_bytes=np.diff(ends), removed=removed, kept=kept)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, removed (byte ranges, maximal runs), kept (the remaining bytes).

    Removed is each byte of the UTF-8 text covered by a LENGTH-byte string that also starts anywhere else in the table,
    the same document included; matches never cross documents. Null counts as empty; shorter texts have no such string;
    rows that repeat an id and its text are distinct places, so all that is long enough goes; null ids are kept apart by
    their text; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    merges = max(16, total // MERGE_BYTES)
    found = stash(docs.mapInArrow(_find_anchors, "anchor long, doc_id long, text_hash long, block int"), "anchors")
    often = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    blocks = found.join(often, "anchor", "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set("block").alias("blocks"))
    left = stash(blocks.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"), "blocks"), "candidates")
    discard(found)
    same = docs["text_hash"].eqNullSafe(left["of_hash"]) & docs["doc_id"].eqNullSafe(left["of"])
    runs = docs.join(left, same).select("doc_id", "text_hash", "text", "blocks").mapInArrow(_runs(merges), "merge int, run binary")
    parts = int(min(merges, max(int(spark.conf.get("spark.sql.shuffle.partitions")), merges // 64)))
    ranges = stash(runs.repartition(parts, "merge").sortWithinPartitions("merge").mapInArrow(_merge, "doc_id long, text_hash long, start long, end long"), "ranges")
    discard(left)
    gone = ranges.groupBy(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash")).agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    same = docs["text_hash"].eqNullSafe(gone["of_hash"]) & docs["doc_id"].eqNullSafe(gone["of"])
    return docs.join(gone, same, "left").select("doc_id", "text", "ranges").mapInArrow(_cut, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def digest(cut: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def sha256(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
