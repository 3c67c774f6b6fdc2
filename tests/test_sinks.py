"""Files written and read again: class files, bias models, facts, length samples; mutated sequences."""

import random

import numpy as np
import pytest

from strandtally.operators import mutation
from strandtally.sources import readers, writers
from strandtally.store import new_path


def test_class_file(spark):
    targets = spark.createDataFrame([(t, f"t{t}") for t in range(900, 0, -7)], "tid long, name string")
    tids = sorted(range(900, 0, -7))
    counts = spark.createDataFrame([("4,18", 3), ("4", 2), ("18,25,893", 9)], "key string, n long")
    assert {4, 18, 25, 893} <= set(tids)
    weights = spark.createDataFrame([("4,18", 4, 0.25), ("4,18", 18, 0.75), ("4", 4, 1.0), ("18,25,893", 18, 0.5), ("18,25,893", 25, 0.125), ("18,25,893", 893, 0.375)], "key string, tid long, w double")
    lengths = spark.createDataFrame([(4, 55.5), (893, 7.0)], "tid long, eff_len double")
    path = new_path(spark, "class-file-test")
    writers.write_class_file(counts, targets, path, weights, lengths)
    lines = [r.value for r in readers.lines_in_order(spark, path).orderBy("line").collect()]
    place = {t: i for i, t in enumerate(tids)}
    assert lines[:2] == [str(len(tids)), "3"] and lines[2 : 2 + len(tids)] == [f"t{t}" for t in tids] and lines[-2:] == ["t4\t55.5", "t893\t7.0"]
    assert f"2\t{place[4]}\t{place[18]}\t0.25\t0.75\t3" in lines
    names, n, members = readers.read_classes(spark, path)
    assert {(r.tid, r.name) for r in names.collect()} == {(i, f"t{t}") for t, i in place.items()} and {r.name: r.eff_len for r in names.collect()}["t11"] == 100.0
    by = {r.class_id: r.n for r in n.collect()}
    got = {}
    for r in members.collect():
        got.setdefault(by[r.class_id], set()).add((r.tid, r.w))
    assert got == {3: {(place[4], 0.25), (place[18], 0.75)}, 2: {(place[4], 1.0)}, 9: {(place[18], 0.5), (place[25], 0.125), (place[893], 0.375)}}
    path = new_path(spark, "class-tables-test")
    writers.write_classes(counts, targets, path, weights)  # the layout of two tables meets its names as well
    names, members = readers.read_class_tables(spark, path)
    name = {r.tid: r.name for r in names.collect()}
    assert {(name[r.tid], r.n, r.w) for r in members.collect()} == {(f"t{t}", {"4,18": 3, "4": 2, "18,25,893": 9}[k], w) for k, t, w in weights.collect()}


def test_bias_models_come_back(spark):
    rows = [("observed", "gc", 1, 2, 0.1), ("expected", "seq5", 262143, 0, 1e-9), ("observed", "pos3", 4, 19, 7.0), ("observed", "gc", 0, 0, 0.0)]
    df = spark.createDataFrame(rows, "kind string, model string, a int, b int, mass double")
    path = new_path(spark, "bias-models-test")
    writers.write_bias_models(df, path)
    assert {tuple(r) for r in readers.read_bias_models(spark, path).collect()} == set(rows[:3])


def test_facts(spark):
    dist = spark.createDataFrame([(0, 0.0), (1, 0.25), (2, 0.5), (3, 0.25)], "length int, p double")
    facts = writers.run_facts(dist, num_processed=8, num_mapped=6, library_types=["IU"])
    assert (facts["percent_mapped"], facts["frag_length_mean"], facts["frag_dist_length"], facts["quant_errors"]) == (75.0, 2.0, 4, []) and facts["frag_length_sd"] == pytest.approx(0.5**0.5)
    assert writers.run_facts()["quant_errors"] == ["insufficient_assigned_fragments"] and list(writers.run_facts()) == list(writers.FACTS)
    with pytest.raises(ValueError):
        writers.run_facts(nothing=1)


def test_length_sample(spark):
    share = np.array([0.0, 0.2, 0.5, 0.3, 0.0])
    dist = spark.createDataFrame([(i, float(c)) for i, c in enumerate(np.cumsum(share))], "length int, c double")
    got = {r.length: r.n for r in writers.length_sample(dist).collect()}
    assert sum(got.values()) == 10_000 and set(got) == {1, 2, 3} and got[2] == pytest.approx(5000, rel=0.05)
    assert got == {r.length: r.n for r in writers.length_sample(dist.repartition(3)).collect()}


def test_mutations(spark):
    rnd = random.Random(1)
    seqs = {t: "".join(rnd.choice("ACGTN") for _ in range(n)) for t, n in ((1, 60_000), (2, 40_000), (3, 0))}
    whole = spark.createDataFrame([*seqs.items(), (4, None)], "tid long, seq string")
    got = {r.tid: r.seq for r in mutation.mutate(whole, 0.02).collect()}
    parts = spark.createDataFrame([(t, a, s[a : a + 7001]) for t, s in seqs.items() for a in range(0, len(s), 7001)], "tid long, from long, seq string")
    joined = {}
    for r in mutation.mutate(parts.repartition(5), 0.02).orderBy("tid", "from").collect():
        joined[r.tid] = joined.get(r.tid, "") + r.seq
    assert joined == {t: got[t] for t in (1, 2)} and got[3] == "" and got[4] is None
    apart = [i for t in (1, 2) for i in range(len(seqs[t])) if seqs[t][i] != got[t][i]]
    row = mutation.difference_rate(whole, mutation.mutate(whole, 0.02)).first()
    assert row.bases == 100_000 and row.differences == len(apart) and row.rate == pytest.approx(0.02, rel=0.1)
    gaps = np.diff([i for i in range(60_000) if seqs[1][i] != got[1][i]])
    assert gaps.mean() == pytest.approx(50, rel=0.1) and gaps.std() == pytest.approx(50, rel=0.15)
    assert mutation.difference_rate(whole, mutation.mutate(whole, 0.0)).first().differences == 0
    with pytest.raises(ValueError):
        mutation.mutate(whole, 1.5)
