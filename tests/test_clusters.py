"""Clusters with a giant one and with hubs, and sums within them, against plain union-find."""

import random
from collections import Counter

import pytest

from strandtally.operators import graph, skew


def plain(edges, vertices):
    up = {v: v for v in vertices}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {v: root(v) for v in vertices}


@pytest.mark.parametrize("kind", ["hub", "path", "random"])
def test_giant_cluster(spark, kind):
    rnd = random.Random(5)
    n, giant = 4000, 3600
    names = list(range(giant))
    rnd.shuffle(names)
    if kind == "hub":
        edges = [(giant - 1, v) for v in range(giant - 1)]
    elif kind == "path":
        edges = list(zip(names[:300], names[1:301], strict=True)) + [(names[0], v) for v in names[301:]]
    else:
        edges = [(names[i], names[rnd.randrange(i)]) for i in range(1, giant)]
    edges += [(v, v + 1) for v in range(giant, n - 1) if v % 5]
    got = graph.connected_components(spark.createDataFrame(edges, "a int, b int").repartition(3), spark.range(n).selectExpr("int(id) as tid"))
    want = plain(edges, range(n))
    assert {r.tid: r.component for r in got.collect()} == want
    masses = {v: float(rnd.randrange(0, 5)) for v in range(n)}
    sums, size = Counter(), Counter(want.values())
    for v, c in want.items():
        sums[c] += masses[v]
    found = graph.projected_counts(spark.createDataFrame(list(masses.items()), "tid int, mass double"), got, got.groupBy("component").count().withColumnRenamed("count", "n"))
    assert {r.tid: pytest.approx(r.projected) for r in found.collect()} == {v: size[c] * masses[v] / sums[c] if sums[c] else 0.0 for v, c in want.items()}


def test_join_values(spark):
    rows = spark.createDataFrame([(i, 0 if i < 1800 else i) for i in range(2000)], "i int, k int")
    values = spark.createDataFrame([(k, k * 2) for k in range(0, 2000, 2)], "k int, v int")
    hot = skew.hot_keys(rows, "k")
    assert [r.k for r in hot.collect()] == [0]
    for how in ("inner", "left"):
        got = sorted((r.i, r.v) for r in skew.join_values(rows, values, "k", hot, how).collect() if r.v is not None or how == "left")
        assert got == sorted(((i, None if k % 2 else 2 * k) for i, k in ((i, 0 if i < 1800 else i) for i in range(2000)) if how == "left" or k % 2 == 0), key=lambda x: x[0])


def test_bounds_of_a_giant_cluster(spark):
    rnd = random.Random(6)
    rows = [(0 if i < 900 else i // 3, i, float(rnd.randrange(1, 50)), rnd.randrange(0, 10), rnd.randrange(20, 60), 0) for i in range(1000)]
    total = Counter()
    for c, _, x, low, high, _ in rows:
        total[c] += int(min(max(x * 1.2, low), high))
    rows = [(c, i, x, low, high, total[c]) for c, i, x, low, high, _ in rows]
    got = {r.tid: r.fitted for r in graph.project_to_bounds(spark.createDataFrame(rows, "component long, tid long, projected double, uniq long, total long, n long")).collect()}
    for c in total:
        own = [r for r in rows if r[0] == c]
        want = graph.fit_bounds(*([r[k] for r in own] for k in (2, 3, 4)), total[c])
        assert [got[r[1]] for r in own] == pytest.approx(want, rel=1e-6)


def test_stars_of_fragments(spark):
    hits = spark.createDataFrame([(1, 7), (1, 3), (1, 3), (2, 3), (2, 7), (3, 7), (4, 7), (4, 7)], "frag int, tid int")
    stars = graph.fragment_stars(hits)
    assert {(r.tid, r.least): (r.n, r.uniq) for r in stars.collect()} == {(3, 3): (2, 0), (7, 3): (2, 0), (7, 7): (2, 2)}
    assert [tuple(r) for r in graph.class_edges(stars).collect()] == [(3, 7)]
    assert {r.tid: (r.total, r.uniq, r.first) for r in graph.target_masses(stars).collect()} == {3: (2, 0, 2), 7: (4, 2, 2)}


def test_values_of_other_keys_do_not_pass_the_driver(spark):
    rows, values = (spark.range(100).selectExpr("id as k", f"id as {c}") for c in "iv")
    plan = skew.join_values(rows, values, "k", rows.filter("k < 0").select("k"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
