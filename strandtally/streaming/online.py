"""A one-pass estimate of target masses, batch by batch.

State is a table of masses by target. Each batch's posterior shares depend on
the masses before it and are added with the batch's forgetting mass. The same
step serves Structured Streaming through foreachBatch, where the state after
each batch is a table that a restart finds again, and a table that is read in
batches."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.inference import forgetting_mass
from ..store import new_path, stored
from .one_pass import step_mass


def log_masses(batches: int, factor: float = 0.65) -> list[float]:
    """Logarithm of each batch's mass, from the first on."""
    out = [0.0]
    for i in range(2, batches + 1):
        out.append(out[-1] + factor * math.log(i - 1) - math.log(i**factor - 1))
    return out


def moved(state: DataFrame, hits: DataFrame, log_mass: float) -> DataFrame:
    """(tid, mass) after a batch of hits (frag, tid)."""
    prior = hits.join(state, "tid", "left").withColumn("m", F.coalesce("mass", F.lit(0.0)) + 1.0)
    share = F.col("m") / F.sum("m").over(Window.partitionBy("frag"))
    got = prior.withColumn("p", share).groupBy("tid").agg((F.sum("p") * math.exp(log_mass)).alias("add"))
    return state.join(got, "tid", "full").select("tid", (F.coalesce("mass", F.lit(0.0)) + F.coalesce("add", F.lit(0.0))).alias("mass"))


def add_batch(state: DataFrame, hits: DataFrame, log_mass: float) -> DataFrame:
    return stored(moved(state, hits, log_mass), "online-state")


def online_masses(events: DataFrame) -> DataFrame:
    """(tid, mass) after all batches, in their order, of rows (batch, event_id, tid); rows of an event_id are one fragment's targets.

    Where no fragment has two targets, its share is 1 whatever the masses before it, so that batches add up in one step."""
    n = events.agg(F.max("batch")).first()[0] or 0
    if events.groupBy("batch", "event_id").count().filter("count > 1").limit(1).count() == 0:
        every = events.sparkSession.range(1, n + 1).withColumnRenamed("id", "batch")
        return events.join(forgetting_mass(every).select("batch", "log_mass"), "batch").groupBy("tid").agg(F.sum(F.exp("log_mass")).alias("mass"))
    path = new_path(events.sparkSession, "online-batches")
    events.select("batch", F.col("event_id").alias("frag"), "tid").repartition("batch").write.partitionBy("batch").parquet(path)
    dealt = events.sparkSession.read.parquet(path)  # each step reads its own part
    state, log_mass = events.select("tid").distinct().withColumn("mass", F.lit(0.0)), 0.0
    for i in range(1, n + 1):
        log_mass += step_mass(i, 0.65)
        state = add_batch(state, dealt.filter(F.col("batch") == i).select("frag", "tid"), log_mass)
    return state


class OnlinePass:
    """For ``writeStream.foreachBatch``: hits (frag, tid) of each micro-batch move the state forward.

    The state after each batch is a table below ``folder``, by its number. Kept beside the stream's checkpoint, it
    outlives the driver: a new OnlinePass with the same folder goes on from the batch before its first. A batch that
    comes again after a failure starts from the state before it and replaces its own, so it counts once."""

    def __init__(self, state: DataFrame, factor: float = 0.65, folder: str | None = None) -> None:
        self.start, self.factor = state, factor
        self.folder = folder or new_path(state.sparkSession, "online-states")

    def after(self, batch: int) -> DataFrame:
        """The state after a batch, of which there must be a table; before the first, that to start with."""
        return self.start if batch < 0 else self.start.sparkSession.read.parquet(f"{self.folder}/batch={batch}")

    def __call__(self, hits: DataFrame, batch: int) -> None:
        moved(self.after(batch - 1), hits, log_masses(batch + 1, self.factor)[batch]).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")

    @property
    def state(self) -> DataFrame:
        every = self.start.sparkSession.read.parquet(self.folder)  # with a column batch
        return self.after(every.agg(F.max("batch")).first()[0])
