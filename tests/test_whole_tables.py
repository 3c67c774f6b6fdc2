"""Queries over all rows of their tables, against plain versions."""

import math
from collections import Counter, defaultdict

import duckdb
import pytest

import __spark_entry__
from strandtally.streaming.online import log_masses

from .test_queries import DATA


def run(spark, name):
    return __spark_entry__.queries()[name](spark, DATA).collect()


def clusters():
    """The targets of each fragment, and the smallest target of each one's cluster."""
    frags = defaultdict(set)
    for f, t in duckdb.sql(f"SELECT l_orderkey, l_partkey FROM '{DATA}/lineitem.parquet'").fetchall():
        frags[f].add(t)
    root = {t: t for ts in frags.values() for t in ts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for ts in frags.values():
        a = min(ts)
        for t in ts:
            x, y = sorted((find(a), find(t)))
            root[y] = x
    return frags, {t: find(t) for t in root}


def test_clusters_of_all_fragments(spark):
    frags, component = clusters()
    assert {r.tid: r.component for r in run(spark, "connected_components")} == component
    mass = Counter(t for ts in frags.values() for t in ts)
    n, whole = Counter(component[min(ts)] for ts in frags.values()), Counter()
    for t, m in mass.items():
        whole[component[t]] += m
    got = {r.tid: r.projected for r in run(spark, "cluster_projected_counts")}
    assert got == pytest.approx({t: n[component[t]] * m / whole[component[t]] for t, m in mass.items()}, abs=1e-4)
    fitted = Counter()
    for r in run(spark, "polytope_projection"):
        assert r.tid in mass and r.fitted <= mass[r.tid] + 1e-6
        fitted[component[r.tid]] += r.fitted
    assert fitted == pytest.approx(n, rel=1e-6)


def test_online_pass_takes_all_batches(spark):
    events = duckdb.sql(f"SELECT event_id // 500, user_id % 25 FROM '{DATA}/events.parquet'").fetchall()
    weight, mass = log_masses(max(b for b, _ in events) + 1), Counter()
    assert len(weight) > 1
    for b, t in events:
        mass[t] += math.exp(weight[b])
    assert {r.tid: r.mass for r in run(spark, "online_pass")} == pytest.approx(mass)


def test_online_masses_beyond_twenty_batches(spark):
    from strandtally.streaming.online import online_masses

    rows = [(b, 2 * b + i, i) for b in range(1, 31) for i in range(2)]
    one = {r.tid: r.mass for r in online_masses(spark.createDataFrame(rows, "batch int, event_id long, tid int")).collect()}
    assert one == pytest.approx({t: sum(math.exp(m) for m in log_masses(30)) for t in range(2)})
    both = spark.createDataFrame([(b, b, i) for b in range(1, 4) for i in range(2)], "batch int, event_id long, tid int")
    assert {r.tid: r.mass for r in online_masses(both).collect()} == pytest.approx({t: sum(math.exp(m) for m in log_masses(3)) / 2 for t in range(2)})


def test_log_add_over_all_alignments(spark):
    n = duckdb.sql(f"SELECT count(DISTINCT l_orderkey) FROM '{DATA}/lineitem.parquet'").fetchall()[0][0]
    got = {r.frag: r.a for r in run(spark, "log_add_pairs")}
    from strandtally.plans.frames import alignments

    scores = defaultdict(list)
    for r in alignments(spark, DATA).collect():
        scores[r.frag].append(0.1 * r.score)
    assert len(got) == n and got == pytest.approx({f: math.log(sum(map(math.exp, x))) for f, x in scores.items()}, abs=1e-5)
