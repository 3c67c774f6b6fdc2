"""Fragment lengths and the effective lengths of targets. Tables by length have one row for each length, a thousand or so."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import value_ranks

KERNEL = (1, 4, 6, 4, 1)  # fixed values: binomial weights, sixteenths


def histogram(lengths: DataFrame, longest: int = 1000) -> DataFrame:
    """(length, n) of a column length; longer ones count as the longest."""
    return lengths.groupBy(F.least("length", F.lit(longest)).cast("int").alias("length")).agg(F.count("*").alias("n"))


def smooth(hist: DataFrame, longest: int = 1000) -> DataFrame:
    """(length, mass): each count spread over five lengths."""
    spread = hist.select(F.explode(F.array(*(F.struct((F.col("length") + d - 2).alias("length"), (F.col("n") * k / 16.0).alias("m")) for d, k in enumerate(KERNEL)))).alias("x"))
    return spread.select("x.*").filter((F.col("length") >= 0) & (F.col("length") <= longest)).groupBy("length").agg(F.sum("m").alias("mass"))


def distribution(mass: DataFrame, column: str = "n") -> DataFrame:
    """(length, p, c, mean): share of a length, of all up to it, and the mean length of those."""
    up_to = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    m = F.col(column).cast("double")
    all_ = F.nullif(F.sum(m).over(whole), F.lit(0.0))
    return mass.select("length", (m / all_).alias("p"), (F.sum(m).over(up_to) / all_).alias("c"), (F.sum(m * F.col("length")).over(up_to) / F.nullif(F.sum(m).over(up_to), F.lit(0.0))).alias("mean"))


def dense(mass: DataFrame, longest: int, column: str = "n") -> DataFrame:
    """``mass`` with a row for every length from 0 on."""
    every = mass.sparkSession.range(longest + 1).select(F.col("id").cast("int").alias("length"))
    return every.join(mass, "length", "left").na.fill(0, [column])


def effective_lengths(targets: DataFrame, dist: DataFrame, longest: int = 1000) -> DataFrame:
    """``targets`` (tid, len) with eff_len: the length less the mean fragment that fits; the length itself if that is below 1."""
    means = dist.select(F.col("length").alias("__l"), "mean")
    joined = targets.join(means, F.least("len", F.lit(longest)) == F.col("__l"), "left")
    short = F.col("len") - F.coalesce("mean", F.lit(0.0))
    return joined.withColumn("eff_len", F.when(short < 1, F.col("len").cast("double")).otherwise(short)).drop("__l", "mean")


def exact_effective_lengths(targets: DataFrame, dist: DataFrame) -> DataFrame:
    """(tid, eff_len): sum over fragment lengths of their share times the places they fit at.

    A range join of targets with the lengths up to theirs; the table of lengths is a thousand rows at most."""
    d = F.broadcast(dist.select("length", "p"))
    fits = targets.join(d, F.col("length") <= F.col("len"))
    return fits.groupBy("tid").agg(F.sum(F.col("p") * (F.col("len") - F.col("length") + 1)).alias("eff_len"))


def length_classes(targets: DataFrame, classes: int = 5) -> DataFrame:
    """``targets`` with length_class: bounds are order statistics at equal ranks, exactly."""
    ranks = value_ranks(targets, "len")
    n = targets.count()
    step = max(1, n // classes)
    at = [min(n, step * (i + 1)) for i in range(classes)]
    held = F.filter(F.array(*map(F.lit, at)), lambda r: (r > F.col("upto") - F.col("n")) & (r <= F.col("upto")))
    bounds = [r.value for r in ranks.select("value", F.explode(held).alias("r")).orderBy("r").collect()]  # one for each class
    cls = F.lit(classes - 1)
    for i in reversed(range(min(len(bounds), classes - 1))):
        cls = F.when(F.col("len") < bounds[i], F.lit(i)).otherwise(cls) if i == 0 else F.when((F.col("len") >= bounds[i - 1]) & (F.col("len") < bounds[i]), F.lit(i)).otherwise(cls)
    return targets.withColumn("length_class", cls)


def truncated_normal(mean: float = 250.0, sd: float = 25.0, longest: int = 1000) -> list[tuple[int, float]]:
    """Share of each length under a normal prior."""
    from math import erf, sqrt

    at = lambda x: 0.5 * (1 + erf((x - mean) / (sd * sqrt(2))))
    mass = [(i, at(i + 0.5) - at(i - 0.5)) for i in range(longest + 1)]
    whole = sum(m for _, m in mass)
    return [(i, m / whole) for i, m in mass]
