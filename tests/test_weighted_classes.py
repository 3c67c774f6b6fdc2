"""Members of classes, their weights and numbers of fragments, from one grouping of the fragments."""

from strandtally.operators import classes


def test_weighted_classes(spark):
    hits = spark.createDataFrame([(1, 3, 0.25), (1, 12, 0.75), (2, 12, 0.25), (2, 3, 0.75), (3, 3, 1.0), (4, 3, 0.5), (4, 12, 0.5)], "frag long, tid int, w double")
    out = classes.weighted_classes(hits)
    assert sorted(map(tuple, out.collect())) == [("3", 3, 1.0, 1), ("3,12", 3, 0.5, 3), ("3,12", 12, 0.5, 3)]
    labelled = classes.labels(hits)
    before = classes.weights(hits, labelled).join(classes.counts(labelled), "key")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, before.collect()))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
