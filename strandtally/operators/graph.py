"""Clusters of targets that share fragments, and counts projected within them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..store import new_path, stored
from .skew import SHARE, hot_keys, join_values


def fragment_stars(hits: DataFrame) -> DataFrame:
    """(tid, least, n, uniq), stored: a fragment links its targets to the least of them; n fragments do so for these two,
    and uniq of them have no other target. Each fragment is counted at its least target, where tid is least.

    Links, masses and bounds all come from this table, so hits are shuffled by fragment once."""
    own = Window.partitionBy("frag")
    rows = hits.select("frag", "tid").repartition("frag").dropDuplicates(["frag", "tid"])
    rows = rows.select("tid", F.min("tid").over(own).alias("least"), (F.count("*").over(own) == 1).alias("alone"))
    return stored(rows.groupBy("tid", "least").agg(F.count("*").alias("n"), F.count_if("alone").alias("uniq")), "fragment-stars")


def class_edges(stars: DataFrame) -> DataFrame:
    """(a, b) of fragment stars: a fragment with k targets gives k - 1 edges."""
    return stars.filter("tid != least").select(F.col("least").alias("a"), F.col("tid").alias("b"))


def target_masses(stars: DataFrame) -> DataFrame:
    """(tid, total, uniq, first), stored: fragments that hit a target, that hit no other, and that have it as their least."""
    first = F.sum(F.when(F.col("tid") == F.col("least"), F.col("n")).otherwise(0))
    return stored(stars.groupBy("tid").agg(F.sum("n").alias("total"), F.sum("uniq").alias("uniq"), first.alias("first")), "target-masses")


def _to_least(rows: DataFrame) -> DataFrame:
    """``rows`` (u, v), stored, with m: the least of u and all v beside it. What is shuffled are partial minima; vertices
    with many rows are joined to theirs by broadcast."""
    least = stored(rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least-neighbours")
    hubs = least.filter(F.col("n") * SHARE > rows.count()).select("u")  # fewer than SHARE
    return join_values(rows, least.select("u", F.least("u", "m").alias("m")), "u", hubs)


def _small_star(rows: DataFrame) -> DataFrame:
    """Each u of ``rows`` (u, v), stored, with v below u, and all its v linked to the least of them."""
    small = _to_least(rows)
    below = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stored(below.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "links")


def connected_components(edges: DataFrame, vertices: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(tid, component): the smallest tid reachable, for every vertex; by alternating stars.

    In turn every vertex links its larger neighbours to its least neighbour, and then itself and its smaller neighbours,
    until each cluster is a star around its least vertex. The second of these comes first once more, as it leaves the
    fewest of many edges, and only it sees them all. Rounds grow with the logarithm of the longest path, edges never
    become more, and neither a hub nor a giant cluster is one key of a shuffle."""
    links = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = _small_star(stored(links, "links"))
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20, 0)"))).first())
    before = mark(now)
    for _ in range(most_rounds):
        both = stored(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "links-both-ways")
        large = stored(_to_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links-large")
        now = _small_star(large)
        after = mark(now)
        if after == before:
            stars = now.withColumnRenamed("u", "tid")
            return vertices.select("tid").distinct().join(stars, "tid", "left").select("tid", F.coalesce("v", "tid").alias("component"))
        before = after
    raise RuntimeError("components did not settle")


def projected_counts(masses: DataFrame, components: DataFrame, fragments: DataFrame) -> DataFrame:
    """(tid, component, n, projected): the fragments of a cluster, dealt by the masses of its targets. A cluster's whole mass is a sum
    by key that is joined back, so a cluster of any size is spread over tasks."""
    m = stored(masses.join(components, "tid").select("tid", "component", "mass"), "cluster-masses")
    whole = m.groupBy("component").agg(F.sum("mass").alias("whole")).join(fragments, "component")
    rows = join_values(m, whole, "component", stored(hot_keys(m, "component"), "clusters-large"))
    share = F.col("mass") / F.nullif("whole", F.lit(0.0))
    return rows.select("tid", "component", "n", F.coalesce(F.col("n") * share, F.lit(0.0)).alias("projected"))


def fit_bounds(projected: list[float], low: list[float], high: list[float], total: float, tolerance: float = 1e-9, most_rounds: int = 5000) -> list[float]:
    """Counts of one cluster within bounds and with a given sum, in plain Python; see project_to_bounds."""
    x, bound = [float(v) for v in projected], [False] * len(projected)
    for _ in range(most_rounds):
        for i, v in enumerate(x):
            if not low[i] <= v <= high[i]:
                x[i], bound[i] = min(max(v, low[i]), high[i]), True
        fixed = sum(v for v, b in zip(x, bound, strict=True) if b)
        loose = sum(x) - fixed
        if abs(fixed + loose - total) <= tolerance * max(1.0, total):
            break
        if loose == 0:  # all are bound, so all are free again
            bound, loose, fixed = [False] * len(x), fixed, 0.0
        if loose == 0:
            break
        x = [v if b else v * (total - fixed) / loose for v, b in zip(x, bound, strict=True)]
    return x


def project_to_bounds(counts: DataFrame, tolerance: float = 1e-9, most_rounds: int = 5000) -> DataFrame:
    """(tid, fitted) for rows (component, tid, projected, uniq, total, n): counts between uniq and total, with the sum n
    in each cluster, as near in proportion to those projected as this allows.

    In each round, counts beyond a bound are set to it and stay there, and the others are scaled to what remains; where
    all are bound and the sum is still off, all are free again. Clusters are sums by key, so one of any size is no group
    in one task; those that have settled leave the rounds. Clusters without any solution (uniq above n or total below it,
    summed) keep their counts of the first round within the bounds."""
    left = stored(counts.select("component", "tid", F.col("projected").cast("double").alias("x"), F.col("uniq").cast("double").alias("low"), F.col("total").cast("double").alias("high"), F.col("n").cast("double").alias("n"), F.lit(False).alias("bound")), "bounds")
    large = stored(hot_keys(left, "component"), "clusters-large")
    settled = new_path(counts.sparkSession, "bounds-settled")
    for _ in range(most_rounds):
        x = F.least(F.greatest("x", "low"), "high")
        rows = left.withColumn("bound", F.col("bound") | (x != F.col("x"))).withColumn("x", x)
        fixed = F.sum(F.when(F.col("bound"), F.col("x")).otherwise(0.0))
        loose = F.sum(F.when(F.col("bound"), 0.0).otherwise(F.col("x")))
        sums = rows.groupBy("component").agg(fixed.alias("fixed"), loose.alias("loose"), F.sum("low").alias("least"), F.sum("high").alias("most"))
        both = join_values(rows, sums, "component", large)
        off = F.abs(F.col("fixed") + F.col("loose") - F.col("n")) > tolerance * F.greatest(F.lit(1.0), F.col("n"))
        can = (F.col("least") <= F.col("n") * (1 + tolerance)) & (F.col("most") >= F.col("n") * (1 - tolerance)) & (F.col("fixed") + F.col("loose") > 0)
        free = F.col("loose") == 0
        scale = F.when(free, F.col("n") / F.nullif(F.col("fixed"), F.lit(0.0))).otherwise((F.col("n") - F.col("fixed")) / F.nullif(F.col("loose"), F.lit(0.0)))
        both = both.withColumn("open", off & can).withColumn("x", F.when(F.col("open") & (free | ~F.col("bound")), F.col("x") * scale).otherwise(F.col("x")))
        both = stored(both.select("component", "tid", "x", "low", "high", "n", (F.col("bound") & ~free).alias("bound"), "open"), "bounds")
        both.filter("NOT open").select("tid", F.col("x").alias("fitted")).write.mode("append").parquet(settled)
        left = both.filter("open").drop("open")
        if left.isEmpty():
            break
    else:
        left.select("tid", F.col("x").alias("fitted")).write.mode("append").parquet(settled)
    return counts.sparkSession.read.parquet(settled)
