"""Small inputs with answers that can be found by hand."""

import math

import pytest
from pyspark.sql import functions as F

from strandtally.functions import formats
from strandtally.functions import sequences as seq
from strandtally.functions.numeric import digamma, log_add, log_sub
from strandtally.operators import abundance, bias, classes, graph, inference, lengths, likelihood, mapping
from strandtally.streaming.online import OnlinePass, log_masses


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_fixed_point(spark):
    c = spark.createDataFrame([("0", 10), ("1", 20), ("0,1", 30)], "key string, n long")
    m = classes.members(c).withColumn("w", F.lit(1.0))
    got = dict(inference.expectation_maximisation(m, 60, tolerance=1e-6, least_rounds=5).collect())
    assert got[0] == pytest.approx(20, abs=0.01) and got[1] == pytest.approx(40, abs=0.01)
    assert sum(got.values()) == pytest.approx(60)
    amb = {r.tid: (r.unique_count, r.ambig_count) for r in classes.ambiguity(c, spark.createDataFrame([(0,), (1,), (2,)], "tid int")).collect()}
    assert amb == {0: (10, 30), 1: (20, 30), 2: (0, 0)}


def test_variational_keeps_the_total(spark):
    c = spark.createDataFrame([("0", 10), ("1", 20), ("0,1", 30)], "key string, n long")
    got = inference.expectation_maximisation(classes.members(c).withColumn("w", F.lit(1.0)), 10, prior=0.01).collect()
    assert sum(r.alpha for r in got) == pytest.approx(60)


def test_tpm_and_genes(spark):
    t = abundance.tpm(spark.createDataFrame([(20.0, 100.0), (40.0, 200.0)], "num_reads double, eff_len double"))
    assert [r.tpm for r in t.collect()] == [500000.0, 500000.0]
    ab = spark.createDataFrame([("a", 100.0, 80.0, 30.0, 3.0), ("b", 200.0, 180.0, 10.0, 1.0), ("c", 100.0, 90.0, 0.0, 0.0), ("d", 200.0, 190.0, 0.0, 0.0), ("e", 7.0, 6.0, 1.0, 1.0)], "name string, length double, effective_length double, tpm double, num_reads double")
    g = {r.gene: r for r in abundance.gene_table(ab, spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "h"), ("d", "h")], "name string, gene string")).collect()}
    assert (g["g"].length, g["g"].effective_length, g["g"].tpm) == (125.0, 105.0, 40.0)
    assert g["h"].length == 150.0 and "e" in g


def test_merge_with_a_gap(spark):
    frame = lambda rows: spark.createDataFrame(rows, "name string, v int")
    got = {r["name"]: (r["s1"], r["s2"]) for r in abundance.merge_samples({"s1": frame([("x", 1)]), "s2": frame([("x", 2), ("y", 3)])}, "v").collect()}
    assert got == {"x": ("1", "2"), "y": ("NA", "3")}
    with pytest.raises(Exception, match="twice"):
        abundance.merge_samples({"s1": frame([("x", 1), ("x", 2)])}, "v").collect()


def test_lengths(spark):
    d = lengths.distribution(spark.createDataFrame([(1, 1), (2, 1)], "length int, n long"))
    assert [r["mean"] for r in d.orderBy("length").collect()] == [1.0, 1.5]
    e = {r.len: r.eff_len for r in lengths.effective_lengths(spark.createDataFrame([(0, 10), (1, 2)], "tid int, len int"), d, 2).collect()}
    assert e == {10: 8.5, 2: 2.0}
    assert sum(p for _, p in lengths.truncated_normal()) == pytest.approx(1)


def test_soft_filter(spark):
    a = spark.createDataFrame([(1, 0, 100), (1, 1, 98), (1, 2, 80)], "frag long, tid int, score int")
    assert [round(r.p, 6) for r in mapping.soft_filter(a).orderBy("tid").collect()] == [1.0, 0.135335]


def test_decoys(spark):
    a = spark.createDataFrame([(1, 0, 10, False), (1, 9, 12, True), (2, 0, 12, False), (2, 9, 12, True), (3, 9, 1, True)], "frag long, tid int, score int, decoy boolean")
    assert [(r.frag, r.tid) for r in mapping.decoy_filter(a).collect()] == [(2, 0)]


def test_range_factorisation(spark):
    h = spark.createDataFrame([(1, 0, 0.75), (1, 1, 0.25)], "frag long, tid int, w double")
    assert classes.labels(h, bins=4).first().key == "0,1|3,1"
    assert classes.labels(h, by_weight=True).first().label == "1,0"


def test_bounds():
    assert graph.fit_bounds([8.0, 2.0], [0.0, 3.0], [10.0, 10.0], 10.0) == pytest.approx([7.0, 3.0])


def test_forgetting_mass(spark):
    got = inference.forgetting_mass(spark.createDataFrame([(1,), (2,), (3,)], "batch int")).orderBy("batch").collect()
    assert got[1].log_mass == pytest.approx(0.563579, abs=1e-5)
    assert [r.log_mass for r in got] == pytest.approx(log_masses(3))


def test_formats(spark):
    assert formats.parse_format("isf") == ("paired", "toward", "SA") and formats.parse_format("A") is None
    with pytest.raises(ValueError):
        formats.parse_format("XY")
    lit = F.lit
    cases = {(True, False, 1, 9): "ISF", (False, True, 9, 1): "ISR", (True, False, 9, 1): "OSF", (False, True, 1, 9): "OSR", (True, True, 1, 9): "MSF", (False, False, 1, 9): "MSR"}
    got = one(spark, *(formats.observed_pair(lit(a), lit(b), lit(p), lit(q)) for a, b, p, q in cases))
    assert got == tuple(cases.values())
    for code, (kind, orientation, strand) in formats.FORMATS.items():
        for seen, (k, o, s) in formats.FORMATS.items():
            if kind == k == "paired" and s != "U":
                assert one(spark, formats.compatible_pair(code, lit(seen))) == (o == orientation and strand in ("U", s),)
    assert one(spark, formats.compatible_single("ISF", lit(True), lit("left")), formats.compatible_single("ISF", lit(True), lit("right")), formats.compatible_single("MSF", lit(True), lit("right"))) == (True, False, True)


def test_sequences(spark):
    s = F.lit("ACGTAC")
    assert one(spark, seq.kmer_code(s), seq.kmer_code(seq.reverse_complement(s)), seq.reverse_complement(F.lit("ANc")), seq.canonical(F.lit("TTT"))) == (433, 2843, "GNT", "AAA")
    assert one(spark, seq.gc_percent(F.lit("CAAAAAAA"), F.lit(0), F.lit(8)), F.size(seq.kmers(F.lit("AC"), 3)), seq.clip_poly_a(F.lit("CAAAAAAAAAAA"))) == (12, 0, "C")
    assert one(spark, seq.cigar_length(F.lit("3S10M2D1I"), "MDN=X"), *seq.unpack_place(seq.pack_place(F.lit(7), F.lit(9))), bias.position_bin(F.lit(99), F.lit(100))) == (12, 7, 9, 19)


def test_logarithms(spark):
    inf = float("-inf")
    a, b, c, d = one(spark, log_add(F.lit(0.0), F.lit(0.0)), log_add(F.lit(inf), F.lit(1.0)), log_sub(F.lit(math.log(3)), F.lit(0.0)), digamma(F.lit(1.0)))
    assert a == pytest.approx(math.log(2)) and b == 1.0 and c == pytest.approx(math.log(2)) and d == pytest.approx(-0.5772156649, abs=1e-9)


def test_posteriors(spark):
    a = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.0), (2, 0, float("-inf"))], "frag long, tid int, log_p double")
    assert [(r.frag, r.p) for r in likelihood.posterior(a).collect()] == [(1, 0.5), (1, 0.5)]
    assert [r.frag for r in likelihood.impossible_fragments(a).collect()] == [2]
    assert inference.posterior_sample(likelihood.posterior(a)).count() == 1


def test_alignment_scores(spark):
    assert mapping.banded_score("ACGT", "ACGT") == 8 and mapping.banded_score("ACGT", "AGT") == 6 - 8 and mapping.infix_distance("CGT", "AACGTAA") == (0, 5)
    c = spark.createDataFrame([(1, 0, 0, "ACGT", "ACGT"), (1, 1, 0, "ACGT", "TTTT")], "frag long, tid int, pos int, read string, target string")
    assert mapping.good_scores(mapping.score_alignments(c), F.lit(4)).count() == 1
    r = spark.createDataFrame([(1, 0, "ACG", "TTCGTTT")], "frag long, tid int, mate string, window string")
    assert mapping.rescue(r, 0).first().at == 5


def test_unsettled_abundances_are_an_error(spark):
    c = spark.createDataFrame([("0", 1000), ("0,1", 3000)], "key string, n long")
    m = classes.members(c).withColumn("w", F.lit(1.0))
    with pytest.raises(RuntimeError):
        inference.expectation_maximisation(m, 2, tolerance=1e-9)


def test_resampling(spark):
    c = spark.createDataFrame([("0", 1000), ("1", 2000), ("0,1", 3000)], "key string, n long")
    m = classes.members(c).withColumn("w", F.lit(1.0))
    draws = inference.bootstrap(m, 20, rounds=30).groupBy("tid").agg(F.avg("alpha").alias("a"), F.stddev("alpha").alias("s")).collect()
    for r in draws:
        assert abs(r.a - {0: 2000, 1: 4000}[r.tid]) < 5 * max(r.s, 1) / 20**0.5 + 100
    g = inference.gibbs(m.withColumn("component", F.lit(0)), 2, 5, thinning=4).groupBy("sample_id").agg(F.sum("alpha").alias("a")).collect()
    assert len(g) == 10 and {r.a for r in g} == {6000.0}


def test_stream_equals_batches(spark, tmp_path):
    rows = [(i, i % 3) for i in range(30)]
    for k in range(3):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], "frag long, tid int").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    state = spark.createDataFrame([(0, 0.0), (1, 0.0), (2, 0.0)], "tid int, mass double")
    online = OnlinePass(state)
    q = spark.readStream.schema("frag long, tid int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*")).writeStream.foreachBatch(online).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    total = sum(r.mass for r in online.state.collect())
    assert total == pytest.approx(10 * sum(math.exp(m) for m in log_masses(3)))
