"""Packing of tokenised documents into fixed-length sequences by cutting-stock column generation."""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import CHUNK_BYTES, batch_of, stash

_tokenizers: dict[str, tuple[object, np.ndarray, dict[str, bytes]]] = {}
#: Pre-tokens that a worker remembers with their ids before it starts anew.
CACHED_WORDS = 300_000
#: Pre-tokens that one text for the tokenizer holds.
TOGETHER = 1000
#: Pieces of one size class that are ranked together, about.
GROUP = 100_000
#: Texts of characters below this one are parted here; others, whose classes depend on the Unicode version, by the tokenizer.
PLAIN = 0x250
#: Capitals below it whose small letters lie beyond it.
_RISING = "".join(chr(c) for c in range(PLAIN) if any(ord(x) >= PLAIN and x != "\u0307" for x in chr(c).lower()))
_ODD = re.compile(f"[\x1c-\x1f\x85{_RISING}{chr(PLAIN)}-\U0010ffff]|<\\|")


def _parting(below: int) -> re.Pattern[str]:
    """The tokenizer's own parting of a lower-cased text of characters below this one; a combining dot is what a dotted
    capital I leaves behind."""
    letters, numbers = ("".join(re.escape(chr(c)) for c in range(below) if unicodedata.category(chr(c))[0] == kind) for kind in "LN")
    return re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+")


_PARTS, _LATIN_PARTS = _parting(PLAIN), _parting(0x100)
#: What ``_ODD`` finds in a text of Latin-1.
_LATIN_ODD = (b"<|", *(bytes([c]) for c in range(256) if _ODD.match(chr(c))))


def parts(text: str) -> list[str] | None:
    """The pre-tokens of a text; None where the tokenizer has to part it. Latin-1 is its own normal form, also in small letters."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return None if _ODD.search(text) else _PARTS.findall(unicodedata.normalize("NFC", text).lower())
    return None if any(x in raw for x in _LATIN_ODD) else _LATIN_PARTS.findall(text.lower())


def _raw(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _ending(model) -> np.ndarray:
    """By id, whether it ends a pre-token: vocabularies with a suffix for that have it nowhere else. Empty if there is none."""
    suffix = json.loads(model.to_str())["model"].get("end_of_word_suffix")
    if not suffix:
        return np.zeros(0, bool)
    ids = np.array([k for word, k in model.get_vocab().items() if word.endswith(suffix)], np.int64)
    return np.bincount(ids, minlength=model.get_vocab_size()) > 0


def encode_words(words: list[str], model, ending: np.ndarray) -> list[bytes]:
    """The ids of each pre-token. Many go to the tokenizer as one text, which parts them at the spaces between; where the ids
    that end a word aren't as many as the words, each goes by itself."""
    groups = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
    alone = lambda group: [_raw(enc.ids) for enc in model.encode_batch_fast(group, add_special_tokens=False)]
    if not len(ending):
        return alone(words)
    out: list[bytes] = []
    for group, enc in zip(groups, model.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
        ids = np.array(enc.ids, "<u4")
        to = (np.flatnonzero(ending[ids]) + 1) * 4
        if len(to) != len(group) or to[-1] != 4 * len(ids):
            out += alone(group)
            continue
        raw, ends = ids.tobytes(), to.tolist()
        out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    return out


def encode(texts: list[str | None], tokenizer: str) -> list[bytes]:
    """Little-endian token ids of each text; null counts as empty.

    The text is normalised, lower-cased and parted as the tokenizer does it, in this order; distinct pre-tokens are encoded
    once and remembered.
    """
    from tokenizers import Tokenizer

    if tokenizer not in _tokenizers:
        model = Tokenizer.from_file(tokenizer)
        _tokenizers[tokenizer] = model, _ending(model), {}
    model, ending, known = _tokenizers[tokenizer]
    out: list[bytes | None] = [None] * len(texts)
    for group in _groups(texts):
        split = {k: words for k in group if (words := parts(texts[k])) is not None}
        distinct: set[str] = set()
        for words in split.values():
            distinct.update(words)
        missing = distinct.difference(known)
        if len(known) + len(missing) > CACHED_WORDS:
            known.clear()
            missing = distinct
        new = list(missing)
        known.update(zip(new, encode_words(new, model, ending), strict=True))
        for k in group:
            out[k] = b"".join(map(known.__getitem__, split[k])) if k in split else _raw(model.encode(texts[k], add_special_tokens=False).ids)
    return [x or b"" for x in out]


def _groups(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[list[int]]:
    """Numbers of the texts that have any, as many at a time as hold ``limit`` characters; a longer text is alone."""
    group, size = [], 0
    for k, t in enumerate(texts):
        if not t:
            continue
        if group and size + len(t) > limit:
            yield group
            group, size = [], 0
        group.append(k)
        size += len(t)
    if group:
        yield group


def tokenise(tokenizer: str, end_id: int, capacity: int):
    """For ``mapInArrow``: the pieces of each document, cut at every ``capacity`` ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist(), tokenizer), strict=True):
                raw = memoryview(ids + _raw([end_id]))
                n = len(raw) // 4
                rows += [(doc_id, at, min(capacity, n - at), zlib.crc32(raw[4 * at : 4 * (at + capacity)]), n) for at in range(0, n, capacity)]
            yield batch_of(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True))) if rows else pa.RecordBatch.from_pylist([], schema)

    return run


class Pricing:
    """Unbounded knapsack over the dual prices by dynamic programming. ``sizes`` ascends."""

    def __init__(self, sizes: np.ndarray, value: np.ndarray, capacity: int):
        self.sizes, self.value, self.capacity = sizes, value, capacity
        self.best, self.pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        fit = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
        for c in range(int(sizes[0]), capacity + 1):
            total = value[: fit[c]] + self.best[c - sizes[: fit[c]]]
            k = int(total.argmax())
            if total[k] > self.best[c - 1]:
                self.best[c], self.pick[c] = total[k], k
            else:
                self.best[c] = self.best[c - 1]

    def column(self, first: int | None = None) -> np.ndarray:
        """How many of each size fill the capacity best, with one of ``first`` among them if given."""
        column, c = np.zeros(len(self.sizes)), self.capacity
        if first is not None:
            column[first], c = 1, c - int(self.sizes[first])
        while c > 0:
            if self.pick[c] < 0:
                c -= 1
            else:
                column[self.pick[c]] += 1
                c -= int(self.sizes[self.pick[c]])
        return column

    def with_each(self) -> np.ndarray:
        """The best value of a column that has a given size."""
        return self.value + self.best[self.capacity - self.sizes]


def fill(sizes: np.ndarray, left: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A pattern of what is left: the largest size, sizes drawn by demand, and the best last pair. ``sizes`` ascends."""
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    pattern[np.flatnonzero(left)[-1]] += 1
    room -= int(pattern @ sizes)
    while True:
        have = left - pattern
        can = np.flatnonzero((have > 0) & (sizes <= room))
        if not len(can):
            return pattern
        mine = sizes[can]
        other = np.searchsorted(mine, room - mine, side="right") - 1
        other -= (other == np.arange(len(can))) & (have[can] < 2)
        pair = mine + np.where(other >= 0, mine[np.maximum(other, 0)], 0)
        k = int(pair.argmax())
        if mine[-1] == room or pair[k] <= mine[-1]:
            pattern[can[-1]] += 1
            room -= int(mine[-1])
        elif pair[k] == room or 2 * mine[0] > room - pair[k] + mine[0]:
            pattern[can[k]] += 1
            pattern[can[other[k]]] += 1
            room -= int(pair[k])
        else:
            k = int(np.searchsorted(np.cumsum(have[can]), rng.random() * have[can].sum(), side="right"))
            pattern[can[min(k, len(can) - 1)]] += 1
            room -= int(mine[min(k, len(can) - 1)])


def use_up(sizes: np.ndarray, demand: np.ndarray, capacity: int, seed: int) -> list[tuple[int, np.ndarray]]:
    """Patterns, and how often each is used, that meet ``demand`` exactly."""
    left, rng, out = demand.astype(np.int64).copy(), np.random.default_rng(seed), []
    while left.any():
        pattern = fill(sizes, left, capacity, rng)
        on = pattern > 0
        times = int((left[on] // pattern[on]).min())
        out.append((times, pattern))
        left -= times * pattern
    return out


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, rounds: int = 60, columns: int = 40, seeds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The cutting-stock linear program: (patterns by row, how often each is used, fractional).

    A revised simplex starts from patterns of one size each and a pool of patterns of ``seeds`` greedy packings. When no
    pattern of the pool improves the program, a knapsack over the dual prices adds the best ones that hold some size,
    until none improves or the lower bound, from the lengths or from the prices (Farley), shows the gap to be below
    ``gap`` or half a sequence.
    """
    fits = capacity // sizes
    patterns, inverse, used = np.diag(fits).astype(float), np.diag(1.0 / fits), demand / fits
    pool = np.array([p for k in range(seeds) for _, p in use_up(sizes, demand, capacity, k)], float)
    bound = float(demand @ sizes) / capacity
    close = lambda: used.sum() - bound <= max(0.5, gap * used.sum())
    for _ in range(rounds):
        for _ in range(6 * len(sizes)):
            worth = pool @ inverse.sum(axis=0)
            if worth[k := int(worth.argmax())] <= 1 + 1e-7 or close():
                break
            u = inverse @ pool[k]
            ratio = np.where(u > 1e-9, used / np.where(u > 1e-9, u, 1), np.inf)
            r = int(ratio.argmin())
            theta, row = ratio[r], inverse[r] / u[r]
            used, u[r] = used - theta * u, 0
            used[r] = theta
            inverse -= np.outer(u, row)
            inverse[r], patterns[r] = row, pool[k]
        duals = np.maximum(inverse.sum(axis=0), 0)
        pricing = Pricing(sizes, duals, capacity)
        bound = max(bound, float(duals @ demand) / max(1.0, pricing.best[-1]))
        if pricing.best[-1] <= 1 + 1e-7 or close():
            break
        worth = pricing.with_each()
        new = [pricing.column(int(k)) for k in np.argsort(-worth, kind="stable")[:columns] if worth[k] > 1 + 1e-7]
        pool = np.concatenate([pool, *([np.array(new)] if new else [])])
    return patterns, np.maximum(used, 0)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {size: how many}) that use up ``histogram`` exactly: rounded-down patterns of the linear program, then greedy ones for the rest, which is under one copy of each pattern."""
    if not (sizes := np.array(sorted(s for s, n in histogram.items() if n), np.int64)).size:
        return []
    left = np.array([histogram[int(s)] for s in sizes], np.int64)
    made: list[tuple[int, np.ndarray]] = []
    for pattern, used in zip(*column_generation(sizes, left.astype(float), capacity), strict=True):
        on = pattern > 0
        if times := min(int(used + 1e-6), int((left[on] // pattern[on]).min())):
            made.append((times, pattern.astype(np.int64)))
            left -= times * made[-1][1]
    made += min((use_up(sizes, left, capacity, k) for k in range(5)), key=lambda x: sum(t for t, _ in x))
    return [(times, {int(sizes[k]): int(p[k]) for k in np.flatnonzero(p)}) for times, p in made]


def size_class(length, exact: int = 64, step: int = 4):
    """The size that a piece of this length is planned as: exact when short, else rounded up to a multiple of ``step``."""
    return F.when(length <= exact, length).otherwise(F.ceil(length / step) * step).cast("long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are tokenised once and cut only at every ``capacity`` ids. The linear program sees the histogram of piece
    lengths (at most ``exact + capacity / step`` classes, so what the driver collects, solves and broadcasts is bounded by
    ``capacity``, not by the input); pieces are ranked within their class in salted groups of about GROUP pieces, and ranks
    address pattern, copy and slot. A null or empty text is one piece that holds only ``end_id``; equal texts are packed separately; null ids are
    kept; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = stash(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tokenise(tokenizer, end_id, capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    pieces = pieces.withColumn("size", size_class(F.col("length")))
    histogram = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = spark.createDataFrame([(s, n // GROUP + 1) for s, n in histogram.items()], "size long, salts long")
    pieces = pieces.join(F.broadcast(salts), "size").withColumn("salt", F.expr("pmod(xxhash64(doc_id, start), salts)")).drop("salts")
    counts = stash(pieces.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    rows, taken, sequence = [], dict.fromkeys(histogram, 0), 0
    for times, has in plan(histogram, capacity):
        slot = 0
        for size, many in has.items():
            rows.append((size, taken[size], taken[size] + times * many, many, sequence, slot))
            taken[size] += times * many
            slot += many
        sequence += times
    slots = spark.createDataFrame(rows, "size long, first long, last long, many long, sequence long, slot long")
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "start")) - 1)
    ranked = ranked.join(offsets, ["size", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(slots), "size").filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    copy = F.col("rank") - F.col("first")
    placed = placed.withColumn("sequence_id", F.expr("sequence + (rank - first) div many")).withColumn("place", F.col("slot") + copy % F.col("many"))
    upto = Window.partitionBy("sequence_id").orderBy("place")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", (F.sum("length").over(upto) - F.col("length")).alias("offset"))
