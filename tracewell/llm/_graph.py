"""Distributed union-find, and the search for linked pairs among the members of shared signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._hash import mix
from ._util import batch_of, chunks, many, stash

#: Features are counted in so many cells by hash, a power of two: 8 MB of sums at any size of the input.
CELL_BITS = 20
#: Parity bits of a set, in words of 64.
MARKS = 16
#: (row, hash) of the distinct features of each text, rows ascending.
Features = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def components(links: DataFrame) -> DataFrame:
    """(id, component) of the ids in ``links`` (a, b) that aren't the smallest of their component; component: the smallest.

    Every id hooks to its smallest neighbour, pointer jumping flattens the forest, and links between roots are contracted,
    until none is left: a logarithmic number of rounds, whose tables are written to the shared folder.
    """
    spark = links.sparkSession
    left = stash(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links", tiny=True)
    found: DataFrame | None = None
    while not left.isEmpty():
        parents = stash(left.groupBy("a").agg(F.min("b").alias("p")), "parents", tiny=True)
        while True:
            up = lambda k: parents.select(F.col("a").alias(f"q{k}"), F.col("p").alias(f"p{k}"))  # noqa: B023, E731
            twice = parents.join(up(1), F.col("p") == F.col("q1"), "left").join(up(2), F.col("p1") == F.col("q2"), "left")
            jumped = stash(twice.select("a", F.coalesce("p2", "p1", "p").alias("p"), F.col("p2").isNotNull().alias("moved")), "jumped", tiny=True)
            parents = jumped.select("a", "p")
            if jumped.filter("moved").isEmpty():
                break
        up = parents.select(F.col("a").alias("q"), F.col("p").alias("pp"))
        old = found and found.join(up, F.col("component") == F.col("q"), "left").select("id", F.coalesce("pp", "component").alias("component"))
        now = parents.select(F.col("a").alias("id"), F.col("p").alias("component"))
        found = stash(old.unionByName(now) if old is not None else now, "components", tiny=True)
        roots = left.join(parents, "a").select(F.col("p").alias("a"), "b").join(up, F.col("b") == F.col("q"), "left").select("a", F.coalesce("pp", "b").alias("b"))
        left = stash(roots.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", tiny=True)
    return found if found is not None else spark.createDataFrame([], "id long, component long")


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and node; the last distinct one waits for the next batch."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])
    key = node = np.zeros(0, np.int64)
    follows = False  # whether the row that waits has one of its key before it
    for some in many(batches):
        key, node = (np.concatenate([x, *(batch.column(c).to_numpy() for batch in some)]) for x, c in ((key, "key"), (node, "node")))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        same = np.concatenate([[follows], key[1:] == key[:-1]])
        keep = same[:-1] | same[1:]
        if keep.any():
            yield batch_of(schema, key=key[:-1][keep], node=node[:-1][keep])
        key, node, follows = key[-1:], node[-1:], bool(same[-1])
    if follows:
        yield batch_of(schema, key=key, node=node)


def shared(rows: DataFrame) -> DataFrame:
    """The distinct (key, node) rows whose key has two nodes or more."""
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shared, "key long, node long")


def stars(members: DataFrame) -> DataFrame:
    """(key, node, least): each member and the smallest of its key."""
    w = Window.partitionBy("key").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return members.withColumn("least", F.first("node").over(w))


def star_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each member with the smallest of its key, once; a > b."""
    return stars(members).filter("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()


def with_component(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found, members["node"] == found["id"], "left").select("key", "node", F.coalesce("component", "node").alias("component"))


def divided(members: DataFrame) -> DataFrame:
    """(key, node, component, size, least) of the keys whose members beside the smallest are still in two components or more.

    Every member was compared with the smallest of its key, so where the others are one component, no pair is left.
    """
    known = stars(members)
    sizes = known.filter("node != least").groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), (F.count(F.lit(1)) + 1).alias("size")).filter("low != high")
    return known.join(sizes.select("key", "size"), "key")


def cross_pairs(members: DataFrame) -> DataFrame:
    """(a, b) of one key and different components, once; a > b, and b isn't the smallest of the key."""
    other = members.filter("node != least").select("key", F.col("node").alias("b"), F.col("component").alias("other"))
    return members.join(other, "key").filter((F.col("node") > F.col("b")) & (F.col("component") != F.col("other"))).select(F.col("node").alias("a"), "b").distinct()


def _cells(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def feature_counts(texts: DataFrame, features: Features) -> np.ndarray:
    """How many of the sets have a feature of each cell: an array of 1 << CELL_BITS sums, whatever the size of ``texts``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cell", pa.int32()), ("sets", pa.int64())])
        sums = np.zeros(1 << CELL_BITS, np.int64)
        for batch in chunks(batches):
            sums += np.bincount(_cells(features(batch.column("text"))[1]), minlength=len(sums))
        at = np.flatnonzero(sums)
        yield batch_of(schema, cell=at.astype(np.int32), sets=sums[at])

    sums = np.zeros(1 << CELL_BITS, np.int64)
    got = texts.select("text").mapInArrow(run, "cell int, sets long").groupBy("cell").agg(F.sum("sets").alias("sets")).toArrow()
    sums[got.column("cell").to_numpy()] = got.column("sets").to_numpy()
    return sums


def marks(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """(rows, MARKS) words of parity bits of the sets: two sets differ in no more of them than they do in features."""
    at = (mix(~h) >> np.uint64(32)).astype(np.int64) & (64 * MARKS - 1)
    odd = (np.bincount(row * (64 * MARKS) + at, minlength=rows * 64 * MARKS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(rows, -1), axis=1, bitorder="little").view(np.int64)


MARKED = ", ".join(f"w{k} long" for k in range(MARKS))


def may_link(x: str, y: str, n: str, m: str, share: tuple[int, int]) -> Column:
    """Whether the parity bits of two sets of sizes ``n`` and ``m`` allow a Jaccard similarity of ``share``; ``x`` and ``y``
    are the prefixes of their columns."""
    num, den = share
    differ = " + ".join(f"bit_count({x}{k} ^ {y}{k})" for k in range(MARKS))
    return F.expr(f"({differ}) * {den + num} <= ({n} + {m}) * {den - num}")


def rare_features(texts: DataFrame, features: Features, share: tuple[int, int]) -> DataFrame:
    """(key, node, size, place, low, parity words): the features of a set that a prefix filter joins on, from (node, text).

    All sets order their features alike, by the count of the feature's cell and then by the feature, so rare ones come first.
    Of two sets whose Jaccard similarity is ``share`` or more, the first common feature under any such order lies among the
    first size - ceil(t * size) + 1 of either, and of the smaller one (column low) even among the first
    size - ceil(2t / (1 + t) * size) + 1. A cell's count is never below a feature's own, so one of 1 is of a single set: it
    takes a place, but gives no key.
    """
    num, den = share
    shared_counts = texts.sparkSession.sparkContext.broadcast(feature_counts(texts, features))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("place", pa.int32()), ("low", pa.bool_()), *((f"w{k}", pa.int64()) for k in range(MARKS))])
        for batch in chunks(batches):
            row, h = features(batch.column("text"))
            odd = marks(row, h, batch.num_rows)
            sets = shared_counts.value[_cells(h)]
            order = np.lexsort((h, sets, row))
            row, h, sets = row[order], h[order], sets[order]
            sizes = np.bincount(row, minlength=batch.num_rows)
            size, place = sizes[row], np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row] + 1
            upto = lambda a, b: size - (size * a + b - 1) // b + 1  # noqa: B023, E731
            keep = (place <= upto(num, den)) & (sets > 1)
            low = (place <= upto(2 * num, num + den))[keep]
            yield batch_of(schema, key=h[keep].view(np.int64), node=batch.column("node").take(pa.array(row[keep])), size=size[keep].astype(np.int32), place=place[keep].astype(np.int32), low=low, **{f"w{k}": odd[row[keep], k] for k in range(MARKS)})

    return texts.select("node", "text").mapInArrow(run, f"key long, node long, size int, place int, low boolean, {MARKED}")


def _bounds(share: tuple[int, int]) -> Column:
    """What sizes n, m and places i, j of a common feature allow."""
    num, den = share
    return F.expr(f"n * {den} >= m * {num} and 1 + least(n - i, m - j) >= ((n + m) * {num} + {num + den - 1}) div {num + den}")


def prefix_pairs(members: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b) of different components that may be linked, once: ``rare_features`` with components, joined under the bounds
    that sizes, places and parity bits set. A pair that is linked passes at its first common feature."""
    side = lambda node, size, place, component, w: [F.col("node").alias(node), F.col("size").alias(size), F.col("place").alias(place), F.col("component").alias(component), *(F.col(f"w{k}").alias(f"{w}{k}") for k in range(MARKS))]
    x = members.filter("low").select("key", *side("x", "n", "i", "c", "u"))
    y = members.select("key", *side("y", "m", "j", "d", "v"))
    smaller = F.expr("n < m or (n = m and x < y)")
    pairs = x.join(y, "key").filter(smaller & _bounds(share) & (F.col("c") != F.col("d")) & may_link("u", "v", "n", "m", share))
    return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def neighbour_pairs(members: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b), once: of ``rare_features`` with components, each member and the one before it in its key by size that
    ``prefix_pairs`` would join it with, where their components differ: no more pairs than members."""
    w = Window.partitionBy("key").orderBy("size", "node").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("low"), F.struct("node", "size", "place", "component")), ignorenulls=True).over(w)
    met = members.select("node", F.col("size").alias("m"), F.col("place").alias("j"), F.col("component").alias("d"), last.alias("x"))
    met = met.select("node", "m", "j", "d", F.col("x.node").alias("x"), F.col("x.size").alias("n"), F.col("x.place").alias("i"), F.col("x.component").alias("c"))
    return met.filter((F.col("c") != F.col("d")) & _bounds(share)).select(F.greatest("x", "node").alias("a"), F.least("x", "node").alias("b")).distinct()


def link_all(members: DataFrame, verify: Callable[[DataFrame], DataFrame], texts: DataFrame, features: Features, share: tuple[int, int], small: int = 24) -> DataFrame:
    """The components of all verified pairs that share a key, without pairing off whole groups.

    First each member is compared with the smallest of its key. Only keys that still span several components need more:
    those of up to ``small`` members compare the pairs that cross components. The members of larger ones are joined on
    their rarest features (``features`` of ``texts``: node, text) instead, again first with the smallest that shares one
    and then under the bounds of a prefix filter, which misses no pair of a similarity of ``share`` or more.
    """
    links = stash(verify(star_pairs(members)), "verified", few=True)
    found = components(links)
    rest = stash(divided(with_component(members, found)), "divided", few=True)
    if rest.isEmpty():
        return found
    large = rest.filter(F.col("size") > small).select("node").distinct()
    rare = stash(rare_features(texts.join(large, "node", "left_semi"), features, share), "rare", few=True)
    apart = lambda: rare.join(found, rare["node"] == found["id"], "left").withColumn("component", F.coalesce("component", "node")).drop("id")
    pairs = cross_pairs(rest.filter(F.col("size") <= small)).unionByName(neighbour_pairs(apart(), share)).distinct()
    links = links.unionByName(stash(verify(pairs), "verified", few=True))
    found = components(links)
    last = stash(verify(prefix_pairs(apart(), share)), "verified", few=True)
    return found if last.isEmpty() else components(links.unionByName(last))
