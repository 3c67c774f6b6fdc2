"""Equivalence classes of fragments.

A class is the set of targets that a fragment may come from, with a weight for
each. Classes are built from long rows (frag, tid, w): labels by one grouping
over fragments, counts by a second one over labels, whose partial sums are
combined before the shuffle. Weights stay in long form and are summed by class
and target, so no array is ever added up element by element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def labels(hits: DataFrame, bins: int = 0, by_weight: bool = False) -> DataFrame:
    """(frag, label, tids, key): a fragment's targets as text and as an array; key has a bin of the weight for each as well.

    bins: range factorisation; the bins of a fragment with k targets number floor(sqrt(k) + bins).
    by_weight: targets in the order of their weights instead of their identifiers."""
    entry = F.struct("w", "tid") if by_weight else F.struct("tid", "w")
    frag = hits.groupBy("frag").agg(F.array_sort(F.collect_list(entry)).alias("e"))  # a fragment's targets are few
    tids = F.transform("e", lambda x: x["tid"])
    label = F.array_join(tids.cast("array<string>"), ",")
    key = label
    if bins:
        ranges = F.floor(F.sqrt(F.size("e").cast("double")) + bins)
        key = F.concat_ws("|", label, F.array_join(F.transform("e", lambda x: F.floor(x["w"] * ranges).cast("string")), ","))
    return frag.select("frag", label.alias("label"), tids.alias("tids"), key.alias("key"))


def counts(labelled: DataFrame, key: str = "label") -> DataFrame:
    """(key, n): fragments of each class."""
    return labelled.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))


def collapse(ranged: DataFrame) -> DataFrame:
    """Classes of (key, n) with bins, as classes of targets alone."""
    return ranged.groupBy(F.substring_index("key", "|", 1).alias("key")).agg(F.sum("n").alias("n"))


def members(classes: DataFrame) -> DataFrame:
    """(key, n, tid) for each target of each class."""
    return classes.select("key", "n", F.explode(F.split(F.substring_index("key", "|", 1), ",").cast("array<int>")).alias("tid"))


def weights(hits: DataFrame, labelled: DataFrame, key: str = "label") -> DataFrame:
    """(key, tid, w): mean weight of a target in a class; the weights of a class sum to 1."""
    sums = hits.join(labelled.select("frag", F.col(key).alias("key")), "frag").groupBy("key", "tid").agg(F.sum("w").alias("s"))
    return sums.select("key", "tid", (F.col("s") / F.sum("s").over(Window.partitionBy("key"))).alias("w"))


def weighted_classes(hits: DataFrame) -> DataFrame:
    """(key, tid, w, n): members of each class with mean weights, which sum to 1 in it, and its number of fragments.

    Of hits with one row for each fragment and target. Fragments are grouped once; sums by class and target leave that
    grouping added up, so fragments are neither joined with their labels nor grouped again to count them."""
    frag = hits.groupBy("frag").agg(F.array_sort(F.collect_list(F.struct("tid", "w"))).alias("e"))
    label = F.array_join(F.transform("e", lambda x: x["tid"]).cast("array<string>"), ",")
    sums = frag.select(label.alias("key"), F.explode("e").alias("x")).groupBy("key", F.col("x.tid").alias("tid")).agg(F.sum("x.w").alias("s"), F.count("*").alias("n"))
    return sums.select("key", "tid", (F.col("s") / F.sum("s").over(Window.partitionBy("key"))).alias("w"), "n")


def length_weights(class_members: DataFrame, lengths: DataFrame, least: float = 1.0) -> DataFrame:
    """Weights divided by effective lengths of at least ``least`` (0 after bias correction), normalised within each class."""
    scaled = class_members.join(lengths, "tid").withColumn("v", F.col("w") / F.greatest(F.col("eff_len"), F.lit(least)))
    return scaled.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy("key"))).drop("w", "eff_len").withColumnRenamed("v", "w")


def ambiguity(classes: DataFrame, targets: DataFrame) -> DataFrame:
    """(tid, unique_count, ambig_count) for every target: fragments of classes with that target alone, and of others."""
    m = members(classes).withColumn("one", ~F.col("key").contains(","))
    got = m.groupBy("tid").agg(_sum_if("one").alias("unique_count"), _sum_if(~F.col("one")).alias("ambig_count"))
    return targets.select("tid").join(got, "tid", "left").na.fill(0, ["unique_count", "ambig_count"])


def _sum_if(test: Column | str) -> Column:
    return F.sum(F.when(F.col(test) if isinstance(test, str) else test, F.col("n")).otherwise(0))


def target_counts(hits: DataFrame) -> DataFrame:
    """(tid, total, uniq): fragments that hit a target, and that hit no other."""
    frag = hits.select("frag", "tid").distinct()
    one = frag.groupBy("frag").agg(F.count("*").alias("k"))
    return frag.join(one, "frag").groupBy("tid").agg(F.count("*").alias("total"), F.count_if(F.col("k") == 1).alias("uniq"))


def degenerate(class_members: DataFrame, alpha: DataFrame, least: float = 1e-300) -> DataFrame:
    """Keys of classes whose members have no mass."""
    mass = class_members.join(alpha, "tid", "left").groupBy("key").agg(F.sum(F.coalesce(F.col("alpha") * F.col("w"), F.lit(0.0))).alias("mass"))
    return mass.filter(F.col("mass") <= least).select("key")
