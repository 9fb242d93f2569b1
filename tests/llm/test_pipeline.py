"""Each stage against its brute-force version, and the whole."""

from collections import defaultdict

import corpus_pipeline as C
from tests.llm import test_decontaminate, test_jaccard, test_langid, test_line_dedup
from tests.llm.data import frame
from tracewell.llm import line_dedup


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "aa", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_stage_list():
    assert [n for n, _ in C.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "packing"]


def test_language_stage_keeps_clean_documents(spark):
    rows = test_langid.corpus(300, 4)
    docs = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)] + [(900, None, "aa"), (901, "12 !!", None)], "doc_id long, text string, lang string")
    got = C.language_id(spark, docs, "")
    assert got.columns == docs.columns
    ids = {r["doc_id"] for r in got.collect()}
    assert not ids & {900, 901} and len(ids) >= 0.98 * len(rows)


def test_line_stage(spark):
    texts = ["one line that is long enough\nanother line, also kept here", "one line that is long enough", "fresh text here\none line that is long enough", ""]
    docs = documents(spark, texts)
    got = C.line_dedup_stage(spark, docs, "")
    assert got.schema == docs.schema
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in got.collect()} == {0: (texts[0], len(texts[0])), 2: ("fresh text here", 15)}


def test_jaccard_stage_keeps_one_of_each_group(spark):
    texts = test_jaccard.near_copies(3, groups=6, copies=5) + [None, "", ""]
    want = {d for d, n, c in test_jaccard.brute(list(enumerate(texts))) if d == c}
    got = C.ngram_jaccard(spark, documents(spark, texts), "")
    assert {r["doc_id"] for r in got.collect()} == want


def test_decontamination_stage(spark, tmp_path):
    texts, items = test_decontaminate.planted()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = C.decontamination(spark, documents(spark, texts), str(tmp_path))
    assert {r["doc_id"] for r in got.collect()} == {r[0] for r in test_decontaminate.brute(texts, items) if not r[5]}


def test_run_packs_what_the_stages_keep(spark, tmp_path):
    rows = test_langid.corpus(60, 7)
    docs = spark.createDataFrame([(i, t, y, "s", len(t)) for i, (t, y) in enumerate(rows)] + [(100, rows[0][0], "aa", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[1][0])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = C.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in got}
    assert 100 not in ids and 1 not in ids and len(ids) >= 50
    length = defaultdict(int)
    for r in got:
        length[r["sequence_id"]] += r["length"]
    assert max(length.values()) <= 2048


def test_repeated_rows_and_clashing_columns(spark):
    docs = frame(spark, ["same words in every row of this\nand more", "same words in every row of this"])
    assert line_dedup.remove_lines(docs).columns == docs.columns
