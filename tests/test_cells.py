"""Seeds made in cells, against the same steps over tables of seeds."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandtally.operators import cells, chaining, mapping
from strandtally.plans import queries

from .test_queries import DATA

K = 5


def tables(spark, id_type="long"):
    rnd = random.Random(5)
    parts = ["".join(rnd.choices("ACGT", k=rnd.randrange(8, 40))) for _ in range(12)]
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    text = lambda n: "".join(x if rnd.random() < 0.7 else flip(x) for x in rnd.choices(parts, k=n))
    name = str if id_type == "string" else int
    targets = [(name(i), text(rnd.randrange(1, 6))) for i in range(60)] + [(name(90), ""), (name(91), "ACG"), (name(92), None), (None, text(3)), (name(93), text(2).lower()), (name(94), "ACGTNNACGTACG" + text(1))]
    targets += [(name(3), text(2)), (name(40), text(2))]  # two rows of one target
    reads = [(i, text(rnd.randrange(1, 5))) for i in range(50)] + [(80, None), (81, ""), (82, "ACGT"), (None, text(2)), (83, "AC-GTACGTAA"), (7, text(2))]
    return spark.createDataFrame(reads, "frag long, seq string"), spark.createDataFrame(targets, f"tid {id_type}, seq string")


def same(got, want):
    names = want.columns
    rows = lambda df: sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    mine, theirs = rows(got), rows(want)
    assert sorted(got.dtypes) == sorted(want.dtypes) and theirs and mine == theirs


@pytest.mark.parametrize("blocks, most_places, listed", [(1, 60, 0), (3, 60, 10**6), (3, 10**6, 0)])
def test_cells_as_tables(spark, monkeypatch, blocks, most_places, listed):
    reads, targets = tables(spark, "string" if blocks > 1 and listed else "long")
    if blocks > 1:
        monkeypatch.setattr(cells, "BLOCK", 2_000)
        monkeypatch.setattr(cells, "LEAST_CELL", 200_000)
        monkeypatch.setattr(cells, "LETTERS", 300)
        monkeypatch.setattr(cells, "SEEDS", 400)
    monkeypatch.setattr(cells, "MOST_LISTED", listed)
    hits = mapping.seed_hits(reads, mapping.kmer_index(targets, K), K, most_places).cache()
    of = lambda then, fields, **how: cells.of_cells(reads, targets, K, then, fields, most_places=most_places, **how)
    same(of(cells.pair_counts, "n long"), hits.groupBy("frag", "tid").agg(F.count("*").alias("n")))
    same(of(cells.diagonals, "diagonal int, seeds long, first int, last int"), mapping.chains(hits))
    same(queries.most_hits(of(cells.most_kmers, "hits long")).filter("frag is not null"), mapping.sketch_map(hits))  # whose join drops null
    fields = "chain long, seeds long, bases long, first int, last int, start int, stop int"
    # rows of one target give seeds at equal places, whose order windows leave open
    one = lambda df: df.filter("frag <> 7 and tid not in ('3', '40')")
    chains = mapping.gapped_chains(hits, K, 40, 3)
    same(one(of(cells.gapped_chains(K, 40, 3), fields)), one(chains))
    same(one(mapping.consensus_filter(of(cells.gapped_chains(K, 40, 3, share=0.65), fields), share=0.65)), one(mapping.consensus_filter(chains)))
    hits.unpersist()


@pytest.mark.parametrize("blocks", [3])
def test_stranded_cells_as_tables(spark, monkeypatch, blocks):
    reads, targets = tables(spark)
    if blocks > 1:
        monkeypatch.setattr(cells, "BLOCK", 2_000)
        monkeypatch.setattr(cells, "LEAST_CELL", 200_000)
        monkeypatch.setattr(cells, "LETTERS", 300)
        monkeypatch.setattr(cells, "SEEDS", 400)
    hits = mapping.stranded_hits(reads, targets, K, 150).cache()
    of = lambda then, fields: cells.of_cells(reads, targets, K, then, fields, stranded=True, most_places=150)
    same(queries.most_hits(of(cells.rising_kmers(K), "fwd boolean, hits long")), mapping.sketch_strands(hits, K))
    one = lambda df: df.filter("frag <> 7 and tid not in (3, 40)")
    fields = "fwd boolean, score long, seeds long, bases long, first long, last long, start long, stop long"
    chains = chaining.collinear_chains(one(hits), K, 60)
    same(one(of(cells.collinear_chains(K, 60), fields)), chains)
    same(one(of(cells.collinear_chains(K, 60, least_bases=14), fields)), chains.filter("bases >= 14"))
    hits.unpersist()


def test_no_seeds(spark):
    reads, targets = tables(spark)
    for r, t in ((reads.limit(0), targets), (reads, targets.limit(0)), (reads.filter("frag = 81"), targets)):
        for then, fields in ((cells.pair_counts, "n long"), (cells.gapped_chains(K, 40), "chain long, bases long")):
            assert cells.of_cells(r, t, K, then, fields).collect() == []


@pytest.mark.parametrize("k", [1, 3, 5, 15, 21, 31])
def test_window_codes(k):
    import pyarrow as pa

    from strandtally.operators import kmers

    rnd = random.Random(k)
    texts = pa.array(["".join(rnd.choices("ACGTN", [9, 9, 9, 9, 1], k=rnd.randrange(0, 90))) for _ in range(40)] + [None, "", "acgt" * 12]).slice(1)
    for stranded in (False, True):
        offsets, row, code, fwd, there = cells._windows(texts, k, stranded)
        _, at, want, other = kmers.strand_codes(texts, k)
        place = there.nonzero()[0]
        assert (place - offsets[row[place]] == at).all()
        assert (code[place] == (want if not stranded else want * (want < other) + other * (want >= other))).all()
        assert fwd is None or (fwd[place] == (want < other)).all()


@pytest.mark.parametrize("name", ["seed_join", "seed_chains", "gapped_chains", "collinear_chains"])
def test_seeds_are_not_shuffled(spark, name):
    """Only letters are dealt out: no join, and no exchange after seeds are made."""
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and "Join" not in plan
    assert plan.index("MapInArrow") < plan.index("Exchange")  # the plan begins with its last step


def test_asked_pairs(spark, monkeypatch):
    reads, targets = tables(spark)
    monkeypatch.setattr(cells, "BLOCK", 2_000)
    monkeypatch.setattr(cells, "LEAST_CELL", 200_000)
    monkeypatch.setattr(cells, "LETTERS", 300)
    asked = spark.createDataFrame([(f, t) for f in range(0, 50, 7) for t in range(0, 60, 3)] + [(500, 1), (1, 500), (81, 2), (None, 4), (7, None), (0, 0)], "frag long, tid long")
    hits = mapping.stranded_hits(reads, targets, K).groupBy("frag", "tid").agg(F.count("*").alias("n"))
    want = hits.join(asked.distinct(), hits.frag.eqNullSafe(asked.frag) & hits.tid.eqNullSafe(asked.tid), "left_semi")
    got = cells.of_cells(reads, targets, K, cells.pair_counts, "n long", stranded=True, asked=asked)
    same(got, want)
    assert got.count() < hits.count() / 2


def test_hopeless_scores_are_not_made(spark, monkeypatch):
    """A part of a target that is far too long for its read is not aligned; the others give the same scores."""
    rnd = random.Random(9)
    target = "".join(rnd.choices("ACGT", k=900))
    reads = spark.createDataFrame([(1, target[100:200]), (2, target[300:345] + target[700:755]), (3, target[500:550] + target[560:610])], "frag long, seq string")
    targets = spark.createDataFrame([(7, target)], "tid long, seq string")
    chains = spark.createDataFrame([(1, 7, True, 0, 100, 100, 200), (2, 7, True, 0, 100, 300, 755), (3, 7, True, 0, 100, 500, 610)], "frag long, tid long, fwd boolean, first long, last long, start long, stop long")
    made = []
    scored = mapping.score_alignments
    monkeypatch.setattr(mapping, "score_alignments", lambda df, **how: made.extend(r.frag for r in df.collect()) or scored(df, **how))
    got = {r.frag: r.score for r in mapping.score_chains(chains, reads, targets).collect()}
    assert sorted(made) == [1, 3] and got == {1: 200, 3: 200 - 6 - 20}
    assert mapping.banded_score(target[300:345] + target[700:755], target[300:755]) < 130
