"""Exact duplicate removal with a heavy-hitter split."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import stash


def misra_gries(counters: int):
    """For ``mapInPandas``: each task's Misra-Gries summary of the column ``digest``, at most ``counters`` rows a task."""

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[bytes, int] = {}
        for frame in frames:
            for digest, n in frame["digest"].value_counts(sort=False).items():
                kept[digest] = kept.get(digest, 0) + int(n)
            if len(kept) > counters:  # merging two summaries: take the (counters + 1)-th largest count from all
                off = sorted(kept.values(), reverse=True)[counters]
                kept = {k: v - off for k, v in kept.items() if v > off}
        if kept:
            yield pd.DataFrame({"digest": list(kept), "least": list(kept.values())})

    return summarise


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their SHA-256 after replacing each ``[\\x20\\x09-\\x0D]+`` by one space is; of equal texts the
    smallest id stays. Misra-Gries summaries of all tasks name at most ``counters`` frequent digests: a digest that holds over
    1/counters of a task's rows is in its summary, and those of the largest sums are taken, so a group that fills much of the
    table is found, and one that is missed only takes the ordinary way; their exact counts and winners, so at most ``counters`` rows, are
    broadcast and settle the hot groups on the map side. All other digests go through one ordinary shuffle.

    Null text counts as empty, and empty texts are equal to each other. Null ids never win over others; a group of null
    ids only has keep_id null and kept false. Rows that repeat an id and its text count in group_size and are all kept if
    that id wins. An empty table gives an empty result; other columns are ignored.
    """
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    rows = stash(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")), "exact-digests")
    found = rows.select("digest").mapInPandas(misra_gries(counters), "digest binary, least long").groupBy("digest").agg(F.sum("least").alias("least"))
    frequent = found.filter("least > 1").orderBy(F.desc("least"), "digest").limit(counters).select("digest")
    ends = (F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    winners = stash(rows.join(F.broadcast(frequent), "digest").groupBy("digest").agg(*ends), "exact-winners")
    split = rows.join(F.broadcast(winners), "digest", "left")
    rest = split.filter("group_size is null").select("digest", "doc_id")
    settled = split.filter("group_size is not null").unionByName(rest.join(rest.groupBy("digest").agg(*ends), "digest"))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    return settled.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
