"""Importance resampling of documents towards a target's n-gram distribution, by hashed n-gram buckets."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._hash import Rolling, lower_ascii, mix, word_spans
from ._util import batch_of, chunks, discard, flat, small_batches, stash, tidy

#: Buckets of the hashed features, and the longest run of words that is one.
BUCKETS, LONGEST = 10_000, 3
#: Bytes of text whose distinct features one slice of the dictionary holds, about, and entries that it takes in at once.
SLICE_BYTES, MERGED = 4 << 20, 2_000_000

#: Bytes inside a word once A-Z are lower-cased: digits, a-z, and all of characters from U+0080 on.
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words_with_spaces(buffer: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes ``buffer[begin:begin + size]`` of all, one after the other."""
    ends = np.cumsum(size)
    return buffer[np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size - begin, size)]


def name(hashes: list[np.ndarray], length: np.ndarray) -> np.ndarray:
    """64-bit names of runs of words, by the hashes of their words, 0 for words that a run doesn't have."""
    out = length.astype(np.uint64)
    for h in hashes:
        out = mix(out + h)
    return out


class Words:
    """The words of some texts: which distinct word each is, and the bytes of those with a space after each."""

    def __init__(self, piece: pa.RecordBatch):
        data, ends = flat(piece.column("text"))
        low = lower_ascii(data)
        starts, stops, before = word_spans(low, ends, INSIDE)
        self.count = np.diff(before)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self.hash, first, self.which = np.unique(Rolling(low)(starts, stops), return_index=True, return_inverse=True)
        self.size = stops[first] - starts[first] + 1
        low = np.append(low, np.uint8(32))
        self.begin = np.cumsum(self.size) - self.size
        self.buffer = words_with_spaces(low, starts[first], self.size)
        self.buffer[self.begin + self.size - 1] = 32

    def runs(self, n: int) -> list[np.ndarray]:
        """The distinct words at each place of all runs of ``n`` words; no run crosses a text."""
        last = max(0, len(self.which) - n + 1)
        inside = self.doc[:last] == self.doc[n - 1 :]
        return [self.which[k : k + last][inside] for k in range(n)]

    def distinct_runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(words, counts) of the distinct runs of up to LONGEST words, sorted: a column a word, -1 where a run is shorter."""
        parts = []
        for n in range(1, LONGEST + 1):
            found = self.runs(n)
            parts.append(np.stack([*found, *[np.full(len(found[0]), -1)] * (LONGEST - n)]))
        every, base = np.concatenate(parts, 1) + 1, len(self.hash) + 1
        if base**LONGEST >= 1 << 63:
            words, count = np.unique(every, axis=1, return_counts=True)
            return words - 1, count
        key = every[0]
        for more in every[1:]:
            key = key * base + more
        key, count = np.unique(key, return_counts=True)
        words = np.empty((LONGEST, len(key)), np.int64)
        for k in range(LONGEST - 1, -1, -1):
            key, words[k] = np.divmod(key, base)
        return words - 1, count

    def packed(self, slices: int) -> Iterator[tuple[int, int, int, bytes]]:
        """(slice, n, size, body) of the distinct runs, dealt to slices by their first two words. A code tells how many words a run
        has, and how many of them the run before it in the slice begins with; those are left out of the text."""
        words, count = self.distinct_runs()
        if not len(count):
            return
        length = (words >= 0).sum(0)
        second = np.where(words[1] >= 0, self.hash[words[1]], np.uint64(0))
        to = (name([self.hash[words[0]], second], np.zeros(len(count))) % np.uint64(slices)).astype(np.int64)
        order = np.argsort(to.astype(np.uint16) if slices <= 1 << 16 else to, kind="stable")
        words, to, length, count = words[:, order], to[order], length[order], count[order]
        same = np.zeros(words.shape, bool)
        same[:, 1:] = (words[:, 1:] == words[:, :-1]) & (to[1:] == to[:-1])
        shared = np.minimum(np.cumprod(same, axis=0, dtype=np.int8).sum(0), length - 1)
        place = np.arange(LONGEST)[:, None]
        own = ((place >= shared) & (place < length)).T
        told = words.T[own]
        cut = np.concatenate(([0], np.cumsum(self.size[told])))[np.concatenate(([0], np.cumsum(own.sum(1))))]
        text = words_with_spaces(self.buffer, self.begin[told], self.size[told])
        codes, counts = (shared * 4 + length).astype(np.uint8), count.astype(np.int32)
        edge = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1, [len(to)]))
        zipped = pa.Codec("zstd", 1)
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            plain = codes[i:j].tobytes() + counts[i:j].tobytes() + text[cut[i] : cut[j]].tobytes()
            yield int(to[i]), j - i, len(plain), zipped.compress(plain, asbytes=True)

    def hashes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, CRC-32) of every run of ``n`` words: those of the words are put together, as the checksum is linear."""
        found, text = self.runs(n), self.buffer.tobytes()
        ends = self.begin + self.size - 1
        if not hasattr(self, "crc"):
            self.crc = np.fromiter((zlib.crc32(text[i:j]) for i, j in zip(self.begin.tolist(), ends.tolist(), strict=True)), np.uint32, len(ends))
        doc = self.doc[: max(0, len(self.which) - n + 1)]
        doc = doc[doc == self.doc[n - 1 :]]
        out = self.crc[found[0]]
        size = self.size - 1
        for words in found[1:]:
            spaced = joined(out, np.ones(len(out), np.int64)) ^ np.uint32(zlib.crc32(b" "))
            out = joined(spaced, np.minimum(size[words], TABLED)) ^ self.crc[words]
        if n > 1:
            for i in np.flatnonzero(np.max([size[w] for w in found[1:]], axis=0) > TABLED).tolist():
                out[i] = zlib.crc32(b" ".join(text[self.begin[w[i]] : ends[w[i]]] for w in found))
        return doc, out


#: Bytes of a word up to which tables continue a checksum.
TABLED = 64


@functools.lru_cache(maxsize=1)
def _zeros() -> np.ndarray:
    """By number of zero bytes, byte of a checksum and its value: the checksum of what follows, of which the four are parts."""
    step = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32) ^ np.uint32(zlib.crc32(b"\0"))
    out = np.empty((TABLED + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, TABLED + 1):
        out[n] = step[out[n - 1] & 255] ^ (out[n - 1] >> np.uint32(8))
    return out


def joined(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What the checksum of a string adds to that of the string and ``size`` more bytes."""
    t = _zeros().reshape(-1)
    at = size * 1024
    return t[at + (crc & 255)] ^ t[at + 256 + ((crc >> 8) & 255)] ^ t[at + 512 + ((crc >> 16) & 255)] ^ t[at + 768 + (crc >> 24)]


def unpack(n: int, size: int, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, counts, text, begins, sizes) of packed runs: 64-bit names, and where in ``text`` their words are, with a space
    after each; a column a word, of no size where a run is shorter."""
    plain = np.frombuffer(pa.Codec("zstd").decompress(body, size, asbytes=True), np.uint8)
    codes, counts, text = plain[:n], plain[n : 5 * n].view(np.int32), plain[5 * n :]
    shared, length = (codes >> 2).astype(np.int64), (codes & 3).astype(np.int64)
    own = length - shared
    stops = np.flatnonzero(text == 32)
    starts = np.concatenate(([0], stops[:-1] + 1))
    hashes = Rolling(text)(starts, stops)
    at, number = np.cumsum(own) - own, np.arange(n)
    begins, sizes, names = [], [], []
    for k in range(LONGEST):
        # word k is the run's own, or that of the last run that brought a word k of its own
        last = np.maximum.accumulate(np.where((shared <= k) & (length > k), number, 0))
        word, has = np.minimum(at[last] + k - shared[last], len(stops) - 1), length > k
        begins.append(starts[word])
        sizes.append(np.where(has, stops[word] + 1 - starts[word], 0))
        names.append(np.where(has, hashes[word], np.uint64(0)))
    return name(names, length), counts, text, np.stack(begins, 1), np.stack(sizes, 1)


class Dictionary:
    """Distinct features with their buckets; of each string the first that comes is hashed, and only that one."""

    def __init__(self, totals: np.ndarray):
        self.totals, self.names, self.buckets = totals, np.zeros(0, np.uint64), np.zeros(0, np.int16)
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, names: np.ndarray, *rest: np.ndarray) -> None:
        self.waiting.append((names, *rest))
        self.held += len(names)
        if self.held >= MERGED:
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        names = np.concatenate([w[0] for w in self.waiting])
        fresh, first, which = np.unique(names, return_index=True, return_inverse=True)
        counts = np.bincount(which, np.concatenate([w[1] for w in self.waiting]), len(fresh)).astype(np.int64)
        at = np.searchsorted(self.names, fresh)
        old = np.append(self.names, np.uint64(0))[at] == fresh
        old &= at < len(self.names)
        bucket = np.zeros(len(fresh), np.int16)
        bucket[old] = self.buckets[at[old]]
        new = np.flatnonzero(~old)
        new = new[np.argsort(first[new])]
        edges = np.searchsorted(first[new], np.cumsum([0, *(len(w[0]) for w in self.waiting)]))
        begin = 0
        for k, (mine, _, text, begins, sizes) in enumerate(self.waiting):
            local = first[new[edges[k] : edges[k + 1]]] - begin
            begin += len(mine)
            strings = words_with_spaces(text, begins[local].ravel(), sizes[local].ravel()).tobytes()
            cuts = np.concatenate(([0], np.cumsum(sizes[local].sum(1)))).tolist()
            bucket[new[edges[k] : edges[k + 1]]] = [zlib.crc32(strings[i : j - 1]) % BUCKETS for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        np.add.at(self.totals, bucket, counts)
        self.names = np.concatenate((self.names, fresh[new]))
        self.buckets = np.concatenate((self.buckets, bucket[new]))
        order = np.argsort(self.names)
        self.names, self.buckets, self.waiting, self.held = self.names[order], self.buckets[order], [], 0


def bucket_counts(texts: DataFrame, text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(bucket, n): occurrences of the features of all texts by bucket.

    Each task counts the distinct strings of some megabytes of text; these go to the slices of a dictionary of distinct strings,
    packed: equal first words once, then compressed. A slice adds the counts of equal strings, hashes each string once, and adds
    up buckets. Strings are told apart by 64-bit hashes. Slices grow in number with the text, so that one fits a task's memory,
    and are dealt by the first two words, so that a frequent word does not fill one.
    """
    small_batches(texts.sparkSession)
    source = texts.select(F.col(text_col).cast("string").alias("text"))
    total = source.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    slices = max(1, -(-total // slice_bytes))
    schema = pa.schema([("slice", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("body", pa.binary())])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches):
            rows = list(Words(piece).packed(slices))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        tidy()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(BUCKETS, np.int64)
        now, known = None, Dictionary(totals)
        for batch in batches:
            for row in range(batch.num_rows):
                slice_, n, size, body = (batch.column(i)[row].as_py() for i in range(4))
                if slice_ != now:
                    known.merge()
                    now, known = slice_, Dictionary(totals)
                known.add(*unpack(n, size, body))
        known.merge()
        tidy()
        filled = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(totals[filled])], ["bucket", "n"])

    packed = source.mapInArrow(pack, "slice long, n long, size long, body binary")
    return packed.repartition("slice").sortWithinPartitions("slice").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text: str = "text") -> np.ndarray:
    """The gain of each bucket, in thousandths of a natural logarithm: what a feature in it tells for the target."""
    s = F.sum("s").over(Window.partitionBy())
    both = bucket_counts(docs, text_col).select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(bucket_counts(target, target_text).select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    every = both.unionByName(docs.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"), F.lit(0).alias("s"), F.lit(0).alias("t"))).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    gain = F.floor(1000 * F.log((F.col("t") + 1) * (s + BUCKETS) / ((F.col("s") + 1) * (F.sum("t").over(Window.partitionBy()) + BUCKETS)))).cast("long")
    rows = every.select("bucket", gain.alias("gain")).collect()  # as many as there are buckets
    gains = np.zeros(BUCKETS, np.int64)
    for r in rows:
        gains[r["bucket"]] = r["gain"]
    return gains


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight): the gains of a document's features, repeats counted, summed up.

    Gains are met by bucket: there are BUCKETS of them, whatever the corpus. A string is not hashed again for that, as the
    checksum of a run of words follows from those of its words."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches):
            words = Words(piece)
            n, weight = np.zeros(piece.num_rows, np.int64), np.zeros(piece.num_rows, np.int64)
            for k in range(1, LONGEST + 1):
                doc, crc = words.hashes(k)
                n += np.bincount(doc, minlength=piece.num_rows)
                # whole numbers far below 2**53, so that the sums are exact
                weight += np.bincount(doc, gains[crc % BUCKETS], piece.num_rows).astype(np.int64)
            yield batch_of(schema, doc_id=piece.column("doc_id"), n_words=words.count, n_features=n, weight=weight)
        tidy()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank: documents drawn without replacement in proportion to how much likelier their
    features are in ``target`` than in ``docs``.

    Score is the weight and a Gumbel variate from the seed and the id, so the largest scores are the draw: ``percent`` of the
    documents of ``least_words`` or more, ranked from 1, equal scores by smaller ids; the others have no rank. Ranks are counted
    in ranges of scores, which are written sorted; none goes through one task.

    Null and empty texts have no features and weight 0, and are not drawn. Rows that repeat an id are drawn separately; a null
    id counts as an empty one in the draw, and comes last among ties. Empty tables give empty results; an empty target
    leaves the gains to the documents alone; other columns are ignored.
    """
    gains = bucket_gains(docs, target, text_col, target_text)
    h = F.conv(F.substr(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), F.lit(1), F.lit(8)), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    rows = weigh(docs, gains, id_col, text_col).withColumns({"score": F.col("weight") + gumbel, "fit": F.col("n_words") >= least_words})
    order = (F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"))
    scored = stash(rows, "resample-scores", few=True)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stash(scored.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "resample-ranges", few=True)
    discard(scored)
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("fit").alias("fits"))  # as many rows as ranges
    ahead = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), F.floor(F.sum("fits").over(Window.partitionBy()) * percent / 100).cast("long").alias("drawn"))
    place = (F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("ahead")).cast("long")
    ranked = dealt.join(F.broadcast(ahead), "part").withColumn("place", place)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (F.col("place") <= F.col("drawn")), F.col("place")).alias("rank"))
