"""Thresholds of joint hits, presets of scores, checks of sources, too few fragments."""

import pytest
from pyspark.sql import functions as F

from strandtally.operators import abundance, likelihood, mapping
from strandtally.sources import readers


def test_joint_hits(spark):
    schema = "frag int, tid int, pos int, fwd boolean, score int"
    left = spark.createDataFrame([(1, 1, 10, True, 50), (1, 2, 10, True, 41), (1, 3, 10, True, 50), (2, 1, 5, True, 30), (3, 1, 5, True, 20), (3, 2, 5, True, 19), (3, 4, 5, True, 18), (5, 1, 0, True, 9)], schema)
    right = spark.createDataFrame([(1, 1, 100, False, 50), (1, 2, 100, False, 50), (1, 3, 900, False, 50), (2, 2, 7, False, 29), (4, 1, 8, True, 3), (5, 1, 20, True, 9)], schema)
    got = sorted((r.frag, r.tid, r.kind, r.score, r.tag) for r in mapping.joint_hits(left, right, 200).collect())
    assert got == [
        (1, 1, "pair", 100, "paired"), (1, 2, "pair", 91, "paired"), (2, 1, "left", 30, "apart"), (2, 2, "right", 29, "apart"), (3, 1, "left", 20, "only_left"), (3, 2, "left", 19, "only_left"),
        (4, 1, "right", 3, "only_right"), (5, 1, "left", 9, "apart"), (5, 1, "right", 9, "apart"),
    ]
    hits = mapping.joint_hits(left, right, 200).filter("frag in (1, 4)")
    for strand, want in (("U", 3), ("SA", 2), ("AS", 1)):  # the mate of 4 lies forward
        assert hits.filter(mapping.fits_library(strand)).count() == want
    with pytest.raises(ValueError):
        mapping.fits_library("X")


def test_presets():
    strict = mapping.PRESETS["strict"]
    assert mapping.banded_scores(["ACGTACGT"], ["ACGAACGT"], rules=strict).tolist() == [7] and mapping.banded_scores(["ACGT"], ["ACGGT"], rules=mapping.PRESETS["aligner"]).tolist() == [0]
    assert mapping.PRESETS["default"] == mapping.ScoreRules() and not strict.orphans and strict.least == 0.8


def test_too_few_fragments(spark):
    counted = spark.createDataFrame([("a", 100, 50.0, 4.0), ("b", 200, 150.0, 5.0)], "name string, length int, eff_len double, num_reads double")
    table, errors = abundance.table_or_empty(counted, 9)
    assert errors and {r.num_reads for r in table.collect()} == {0.0}
    table, errors = abundance.table_or_empty(counted, 10)
    assert not errors and {r.name: r.num_reads for r in table.collect()} == {"a": 4.0, "b": 5.0}


def test_sources(spark):
    pairs = spark.createDataFrame([(0, 0, "A", "C"), (0, 1, "A", None)], "pair int, rec long, seq1 string, seq2 string")
    assert readers.check_mates(pairs.filter("rec = 0")).count() == 1
    with pytest.raises(ValueError, match="record 1"):
        readers.check_mates(pairs)
    headers = spark.createDataFrame([("f", 0, "t", 9, False), ("f", 1, "d", 9, True)], "file string, ord int, name string, len int, decoy boolean")
    assert readers.refuse_decoys(headers.filter("not decoy")).count() == 1
    with pytest.raises(ValueError, match="such as d"):
        readers.refuse_decoys(headers)
    flags = spark.createDataFrame([(99,)], "flag int")
    assert readers.looks_paired(flags) is True and readers.looks_paired(flags.select((F.col("flag") - 99).alias("flag"))) is False and readers.looks_paired(flags.limit(0)) is None
    p = spark.createDataFrame([(0.5,), (0.0,), (None,)], "p double").select(likelihood.log_alignment(F.col("p")).alias("l"))
    assert [r.l for r in p.collect()] == [pytest.approx(-0.693147, abs=1e-5), 0.0, 0.0]
