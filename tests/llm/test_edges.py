"""Nulls, empty and long texts, ties, repeated rows, empty tables and columns with clashing names, for each operator."""

import hashlib
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandtally.llm import content_sort, language_id, license_scan, ngram_join, packing, pii, quality_rules, suffix_tree, warc, word_bpe

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.", "en", "a", 10), (2, "The quick brown fox jumps over the lazy dog.", "en", "a", 10), (2, "The quick brown fox jumps over the lazy dog.", "en", "a", 10),
    (3, None, "en", None, None), (4, "", None, "b", 0), (None, "Le renard brun saute par-dessus le chien.", "fr", "b", 4), (None, None, None, None, None), (5, LONG, "en", "a", 9),
    (6, LONG + " end", "en", "a", 9), (7, " \t\n ", "fr", "b", 4), (8, "mail anna@example.org or +1 (234) 555-6789", "en", "b", 3), (9, "<|endoftext|> ÀÉ ½ 中文", "fr", "c", 3), (10, "a", "en", "c", 1), (10, "b", "en", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["kept", "n_words", "row", "cls", "n", "piece", "bin", "at", "letter", "print", "lines", "score", "top_symbol_ratio", "g_lang", "sha", "id", "part", "word"]
NET = language_id.NetRules(hidden=3, epochs=1)
TREE = suffix_tree.TreeRules(common=5, depth=3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(f"own {c}") for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


OPERATORS = {
    "language": lambda d: language_id.language_id(d, NET),
    "content sort": lambda d: content_sort.decisions(d, partitions=3),
    "bpe": lambda d: word_bpe.encode_decode_digests(d, public_tokenizers.path("word_bpe_49k.json")),
    "join": ngram_join.ngram_jaccard_join,
    "pii": pii.find_pii,
    "packing": lambda d: packing.best_fit_packing(d, public_tokenizers.path("byte_bpe_50k.json")),
    "tree": lambda d: suffix_tree.lm_scores(d, TREE),
    "licenses": license_scan.scan_licenses,
    "quality": quality_rules.quality_rules,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each(docs, none, name):
    got = OPERATORS[name](docs).collect()
    ids = [r.doc_id for r in got if getattr(r, "piece", 0) == 0]
    assert sorted(ids, key=str) == sorted([r[0] for r in ROWS], key=str)
    assert OPERATORS[name](none).collect() == []


def test_language_edges(docs):
    got = {r.doc_id: r for r in language_id.language_id(docs.filter("doc_id is not null"), NET).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 7)) and got[10].lang_pred in ("en", "fr")
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


def test_content_sort_edges(docs):
    for keep in ("largest", "smallest"):
        got = content_sort.decisions(docs, keep, partitions=3).collect()
        fox = [r for r in got if r.doc_id in (1, 2)]
        assert {(r.group_size, r.keep_id) for r in fox} == {(3, 2 if keep == "largest" else 1)} and sum(r.kept for r in fox) == 1
        empty = [r for r in got if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
        assert {(r.group_size, r.keep_id) for r in empty} == {(3, 4 if keep == "largest" else 3)} and sum(r.kept for r in empty) == 1


@pytest.mark.parametrize("partitions", [1, 7])
def test_a_hot_text_over_many_partitions(spark, partitions):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"))
    got = content_sort.decisions(rows, partitions=partitions).filter("text_sha256 = sha2('hot', 256)").agg(F.min("group_size"), F.max("group_size"), F.min("keep_id"), F.count_if("kept")).first()
    n = sum(i % 3 > 0 for i in range(4000))
    assert tuple(got) == (n, n, 3998, 1)
    kept = content_sort.distinct_rows(rows.withColumn("x", F.col("doc_id") * 2), "smallest", partitions)
    assert kept.columns == ["doc_id", "text", "x"] and kept.count() == 4000 - n + 1 and kept.filter("text = 'hot'").first().x == 2


def test_stages_keep_columns(docs, none):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(docs.sparkSession, docs, "")
        assert out.columns == docs.columns, name
        out.collect()
        assert stage(docs.sparkSession, none, "").collect() == []
    assert corpus_pipeline.STAGES[-1][1](docs.sparkSession, none, "").collect() == []


def test_near_stage_rows(docs):
    got = corpus_pipeline.near(docs.sparkSession, docs, "").select("doc_id", "text").collect()
    ids = [r.doc_id for r in got]
    assert ids.count(1) == 1 and 2 not in ids and 5 in ids and 6 not in ids and {3, 4, 7} <= set(ids) and ids.count(10) == 2


def test_warc_edges(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>é</p>"), (2, None, "<p>é</p>"), (2, "http://b/\r\nX: y", "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, "u", "x"), (None, "u", "<p>é</p>")], "page_id long, url string, html string").withColumn("file", F.lit("own"))
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    assert got == sorted([(1, 9, "response", None), (2, 9, "revisit", 1), (2, 9, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (0, 1, "response", None), (0, 9, "revisit", 1)], key=str)
    assert {r.record_type for r in warc.round_trip(pages, least_bytes=10).collect()} == {"response"}
    assert warc.round_trip(pages.limit(0)).collect() == []
