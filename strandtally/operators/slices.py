"""Parts of target sequences for rows that need them.

Targets are kept as blocks that overlap, so a join by (target, block) ships a
slice to each row and never a whole sequence; a slice longer than the overlap is
put together from the blocks that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, OVERLAP = 1 << 14, 1 << 12


def target_blocks(targets: DataFrame, block: int = BLOCK, overlap: int = OVERLAP) -> DataFrame:
    """(tid, block, seq) of targets (tid, seq): ``block`` letters each and the ``overlap`` letters behind them."""
    number = F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.length("seq") - 1, F.lit(0)) / block).cast("int")))
    rows = targets.filter("seq is not null").select("tid", "seq", number.alias("block"))
    return rows.select("tid", "block", F.substring("seq", F.col("block") * block + 1, F.lit(block + overlap)).alias("seq"))


def with_slices(wanted: DataFrame, blocks: DataFrame, block: int = BLOCK, overlap: int = OVERLAP) -> DataFrame:
    """``wanted`` (with tid, from, to, which lie on the target) with ``slice``, the letters from ``from`` up to ``to``."""
    own = [c for c in wanted.columns]
    whole = wanted.withColumn("block", F.floor(F.col("from") / block).cast("int"))
    length = F.col("to") - F.col("from")
    short = whole.filter(length <= overlap).join(blocks, ["tid", "block"])
    short = short.select(*own, F.substring("seq", (F.col("from") - F.col("block") * block + 1).cast("int"), length.cast("int")).alias("slice"))
    long = whole.filter(length > overlap).withColumn("mark", F.monotonically_increasing_id())
    last = F.floor((F.col("to") - 1) / block).cast("int")
    parts = long.withColumn("block", F.explode(F.sequence(F.col("block"), last))).join(blocks, ["tid", "block"])
    begin = F.greatest(F.col("from"), F.col("block").cast("long") * block)
    end = F.least(F.col("to"), (F.col("block").cast("long") + 1) * block)
    piece = F.struct("block", F.substring("seq", (begin - F.col("block") * block + 1).cast("int"), (end - begin).cast("int")).alias("s"))
    joined = parts.groupBy("mark", *own).agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["s"]), "").alias("slice"))
    return short.unionByName(joined.drop("mark"))
