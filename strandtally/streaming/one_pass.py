"""One-pass inference: masses of targets and the distribution of fragment lengths learn from each other, batch by batch.

In each batch an alignment's chance comes from the state before it: the mass of
its target, its own weight, an even start on the target, and, once there are
enough fragments, the fragment's length. At first lengths don't count; then their
share does; after the burn-in that share given that it fits on the target.
Shares within a fragment, times the batch's forgetting mass, are added to the
masses, and until the burn-in to the lengths as well (each share in place of a
draw by it). The state after a batch is one table: targets, a thousand lengths
and the number of fragments. A step reads that and its batch, nothing else, so a
pass reads its input once; a restart goes on from the last table."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import LOG_EPSILON
from ..operators.lengths import KERNEL, dense, distribution, smooth
from ..store import new_path

#: Targets up to which their masses are broadcast: some 20 bytes each.
MOST_BROADCAST = 2_000_000
#: Targets up to which the driver holds their masses between the steps of a pass over a table: 24 bytes each.
MOST_HELD = 100_000
#: Hits that are worth a task of their own in such a step.
HITS_EACH = 200_000


@dataclass(frozen=True)
class PassRules:
    """before_lengths: fragments before lengths count. burn_in: fragments before lengths are settled.
    factor: of the forgetting mass. prior: mass of every target before any fragment. longest: length that longer ones count as."""

    before_lengths: int = 5_000
    burn_in: int = 5_000_000
    factor: float = 0.65
    prior: float = 0.005
    longest: int = 1_000


def step_mass(batch: int, factor: float) -> float:
    """What the logarithm of the forgetting mass grows by from batch - 1 to batch; batches count from 1."""
    return 0.0 if batch < 2 else factor * math.log(batch - 1) - math.log(batch**factor - 1)


class OnePass:
    """Called with each batch of alignments (frag, tid, w, frag_len) and its number, from 0 on, as foreachBatch does; w is
    the alignment's own weight, a null frag_len a fragment of unknown length. All alignments of a fragment are in one batch.

    targets: (tid, len). The state after batch b is the table ``folder``/batch=b; a batch that comes again replaces its own."""

    def __init__(self, targets: DataFrame, rules: PassRules = PassRules(), folder: str | None = None, lengths: DataFrame | None = None) -> None:
        self.targets, self.rules, self.spark = targets.select("tid", "len"), rules, targets.sparkSession
        self.folder = folder or new_path(self.spark, "one-pass")
        self.few = targets.count() <= MOST_BROADCAST
        masses = self.targets.select(F.lit("mass").alias("kind"), F.col("tid").cast("long").alias("id"), F.lit(rules.prior).alias("value"))
        start = dense(lengths, rules.longest, "mass") if lengths is not None else self.spark.range(rules.longest + 1).select(F.col("id").cast("int").alias("length"), F.lit(1.0 / (rules.longest + 1)).alias("mass"))
        self.start = masses.unionByName(start.select(F.lit("length").alias("kind"), F.col("length").cast("long").alias("id"), F.col("mass").cast("double").alias("value")))

    def after(self, batch: int) -> DataFrame:
        """(kind, id, value): the state after a batch; before the first, that to start with."""
        return self.start if batch < 0 else self.spark.read.parquet(f"{self.folder}/batch={batch}")

    def counters(self, batch: int) -> dict[str, float]:
        """Fragments seen and the logarithm of the forgetting mass."""
        return {"fragments": 0.0, "log_mass": 0.0} | ({} if batch < 0 else {r.kind: r.value for r in self.after(batch).filter("id = -1").collect()})

    def length_factor(self, hits: DataFrame, state: DataFrame, seen: float) -> DataFrame:
        """``hits`` with log_fl."""
        if seen < self.rules.before_lengths:
            return hits.withColumn("log_fl", F.lit(0.0))
        top = F.lit(self.rules.longest)
        dist = distribution(state.filter("kind = 'length'").select(F.col("id").cast("int").alias("length"), "value"), "value")
        p = dist.select(F.col("length").alias("__l"), F.log(F.nullif("p", F.lit(0.0))).alias("__p"))
        rows = hits.join(F.broadcast(p), F.least("frag_len", top) == F.col("__l"), "left")  # a row for each length
        share = F.coalesce("__p", F.lit(LOG_EPSILON))
        if seen >= self.rules.burn_in:
            c = dist.select(F.col("length").alias("__m"), F.log(F.nullif("c", F.lit(0.0))).alias("__c"))
            rows = rows.join(F.broadcast(c), F.least("len", top) == F.col("__m"), "left")
            share = F.when((F.col("frag_len") < F.col("len")) & F.col("__p").isNotNull() & F.col("__c").isNotNull(), F.col("__p") - F.col("__c")).otherwise(LOG_EPSILON)
        return rows.withColumn("log_fl", F.when(F.col("frag_len").isNull(), 0.0).otherwise(share))

    def __call__(self, hits: DataFrame, batch: int) -> None:
        before = self.after(batch - 1)
        now = self.counters(batch - 1)
        seen, log_mass = now["fragments"], now["log_mass"] + step_mass(batch + 1, self.rules.factor)
        masses = before.filter("kind = 'mass'").select(F.col("id").alias("__t"), F.col("value").alias("mass"))
        near = F.broadcast if self.few else lambda df: df
        rows = hits.select("frag", "tid", "w", "frag_len").join(near(self.targets), "tid").join(near(masses), F.col("tid") == F.col("__t"))
        rows = self.length_factor(rows, before, seen)
        log_p = F.log(F.nullif(F.col("mass") * F.col("w"), F.lit(0.0))) + F.col("log_fl") - F.log(F.greatest("len", F.lit(1)).cast("double"))
        own = Window.partitionBy("frag")
        rows = rows.withColumn("log_p", log_p).withColumn("e", F.exp(F.col("log_p") - F.max("log_p").over(own)))
        rows = rows.withColumn("p", F.col("e") / F.sum("e").over(own)).filter("p is not null")
        rows = rows.select("frag", "tid", F.when(F.col("frag_len").isNotNull(), F.least("frag_len", F.lit(self.rules.longest))).cast("int").alias("length"), (F.col("p") * math.exp(log_mass)).alias("add"), F.lit(1.0).alias("one"))
        # one aggregation serves the state: masses, lengths, fragments
        parts = [_part("mass", F.col("tid"), F.col("add")), _part("fragments", F.lit(-1), F.col("p_frag"))]
        if seen < self.rules.burn_in:
            parts.append(_part("length", F.col("length"), F.col("add")))
        rows = rows.withColumn("p_frag", F.col("add") / math.exp(log_mass))
        sums = rows.select(F.explode(F.array(*parts)).alias("x")).select("x.*").filter("id is not null").groupBy("kind", "id").agg(F.sum("value").alias("value"))
        sums = sums.persist()  # read twice below; made again if an executor is lost
        spread = smooth(sums.filter("kind = 'length'").select(F.col("id").cast("int").alias("length"), F.col("value").alias("n")), self.rules.longest)
        added = sums.filter("kind != 'length'").unionByName(spread.select(F.lit("length").alias("kind"), F.col("length").cast("long").alias("id"), F.col("mass").alias("value")))
        mark = self.spark.createDataFrame([("log_mass", -1, log_mass)], "kind string, id long, value double")
        new = before.filter("kind != 'log_mass'").unionByName(added).groupBy("kind", "id").agg(F.sum("value").alias("value")).unionByName(mark)
        new.coalesce(8 if self.few else 200).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        sums.unpersist()

    def masses(self, batch: int) -> DataFrame:
        return self.after(batch).filter("kind = 'mass'").select(F.col("id").alias("tid"), F.col("value").alias("mass"))

    def lengths(self, batch: int) -> DataFrame:
        return self.after(batch).filter("kind = 'length'").select(F.col("id").cast("int").alias("length"), F.col("value").alias("mass"))


def _part(kind: str, id_: Column, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), id_.cast("long").alias("id"), value.cast("double").alias("value"))


def _sums_of(tids: np.ndarray, mass: np.ndarray, lens: np.ndarray, log_p: np.ndarray | None, log_c: np.ndarray | None, top: int, settled: bool):
    """A task's part of a step: (kind, id, value) sums of the shares of fragments (hits), each a row with all its hits.
    log_p, log_c: logarithms of the share of each length and of all up to it, as far as lengths count."""
    order = np.argsort(tids)
    sorted_tids = tids[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_target, by_length, whole = np.zeros(len(tids)), np.zeros(top + 1), 0.0
        for batch in batches:
            hits = batch.column(0)
            rows = hits.flatten()
            frag = np.repeat(np.arange(len(hits)), pc.list_value_length(hits).to_numpy(zero_copy_only=False))
            tid, w, size = (pc.struct_field(rows, x) for x in ("tid", "w", "frag_len"))
            known = size.is_valid().to_numpy(zero_copy_only=False)
            ok = (tid.is_valid().to_numpy(zero_copy_only=False)) & w.is_valid().to_numpy(zero_copy_only=False)
            tid, w, size = (pc.fill_null(x, 0).to_numpy(zero_copy_only=False) for x in (tid, w, size))
            at = np.minimum(np.searchsorted(sorted_tids, tid), max(len(tids) - 1, 0))
            ok &= (sorted_tids[at] == tid) if len(tids) else False
            frag, known, w, size, at = frag[ok], known[ok], w[ok], size[ok], order[at[ok]]
            x = mass[at] * w
            ok = ~(x <= 0)
            frag, known, x, size, at = frag[ok], known[ok], x[ok], size[ok], at[ok]
            if not len(frag):
                continue
            log = np.log(x) - np.log(np.maximum(lens[at], 1).astype(float))
            bin_ = np.minimum(size, top)
            inside = bin_ >= 0
            if log_p is not None:
                share = np.where(inside, log_p[np.maximum(bin_, 0)], np.nan)
                if settled:
                    fits = (size < lens[at]) & (lens[at] >= 0)
                    share = np.where(fits, share - log_c[np.clip(lens[at], 0, top)], np.nan)
                log += np.where(known, np.where(np.isnan(share), LOG_EPSILON, share), 0.0)
            first = np.flatnonzero(np.append(True, frag[1:] != frag[:-1]))
            own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(frag))))
            e = np.exp(log - np.maximum.reduceat(log, first)[own])
            p = e / np.add.reduceat(e, first)[own]
            by_target += np.bincount(at, p, len(tids))
            whole += p.sum()
            if not settled:
                ok = known & inside
                by_length += np.bincount(bin_[ok], p[ok], top + 1)
        some = np.flatnonzero(by_target != 0), np.flatnonzero(by_length != 0)
        kind = ["mass"] * len(some[0]) + ["length"] * len(some[1]) + ["fragments"]
        ids = np.concatenate([some[0], some[1], [-1]]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(ids), pa.array(np.concatenate([by_target[some[0]], by_length[some[1]], [whole]]))], names=["kind", "id", "value"])

    return run


class _Held:
    """The state of a pass between its steps, for targets few enough that the driver holds it: a mass for each, a thousand lengths."""

    def __init__(self, run: OnePass, targets: pd.DataFrame) -> None:
        self.run, self.rules = run, run.rules
        self.tids, self.lens = targets["tid"].to_numpy(np.int64), targets["len"].to_numpy(np.int64)
        start = run.start.filter("kind = 'length'").orderBy("id").toPandas()
        self.mass, self.lengths = np.full(len(self.tids), run.rules.prior), start["value"].to_numpy(float)
        self.seen = self.log_mass = 0.0

    def step(self, batch: int, rows: DataFrame | None) -> None:
        """One job without a shuffle; of each task only sums come back."""
        self.log_mass += step_mass(batch + 1, self.rules.factor)
        if rows is None:
            return
        top, settled, log_p, log_c = self.rules.longest, self.seen >= self.rules.burn_in, None, None
        if self.seen >= self.rules.before_lengths:
            known = lambda x: np.log(np.where(x > 0, x, np.nan))
            whole = self.lengths.sum() or np.nan
            log_p, log_c = known(self.lengths / whole), known(np.cumsum(self.lengths) / whole)
        got = rows.mapInArrow(_sums_of(self.tids, self.mass, self.lens, log_p, log_c, top, settled), "kind string, id long, value double").toArrow()
        kind, ids, value = got["kind"].to_numpy(), got["id"].to_numpy(), got["value"].to_numpy()
        sums = lambda k, n: np.bincount(ids[kind == k], value[kind == k], n)
        scale = math.exp(self.log_mass)
        self.mass = self.mass + scale * sums("mass", len(self.tids))
        spread = np.convolve(scale * sums("length", top + 1), np.array(KERNEL) / 16.0)[2 : top + 3]
        self.lengths, self.seen = self.lengths + spread, self.seen + value[kind == "fragments"].sum()

    def write(self, batch: int) -> None:
        parts = [pd.DataFrame({"kind": k, "id": np.asarray(i, np.int64), "value": np.asarray(v, float)}) for k, i, v in (
            ("mass", self.tids, self.mass), ("length", np.arange(len(self.lengths)), self.lengths), ("fragments", [-1], [self.seen]), ("log_mass", [-1], [self.log_mass]))]
        state = self.run.spark.createDataFrame(pd.concat(parts), "kind string, id long, value double")
        state.coalesce(1).write.mode("overwrite").parquet(f"{self.run.folder}/batch={batch}")


def _few_targets(targets: DataFrame) -> pd.DataFrame | None:
    """(tid, len) of targets that the driver can hold and that are told apart by their tid."""
    if targets.limit(MOST_HELD + 1).count() > MOST_HELD:
        return None
    pdf = targets.select(F.col("tid").cast("long").alias("tid"), F.col("len").cast("long").alias("len")).toPandas()
    return pdf if pdf.notna().all(axis=None) and pdf["tid"].is_unique else None


def whole_pass(alignments: DataFrame, targets: DataFrame, rules: PassRules = PassRules(), folder: str | None = None, keep_each: int = 100) -> tuple[OnePass, int]:
    """A pass over a table of alignments (batch from 0 on, frag, tid, w, frag_len), which is dealt by batch once, so that
    each step reads its own part of it. Returns the pass and its last batch.

    With at most MOST_HELD targets the state stays on the driver between steps and each step is one job without a shuffle,
    as fragments are dealt with all their hits; states are written after every ``keep_each`` batches and the last one."""
    run = OnePass(targets, rules, folder)
    path = new_path(run.spark, "one-pass-batches")
    columns = alignments.select("batch", "frag", "tid", "w", "frag_len")
    few = _few_targets(run.targets)
    if few is None:
        columns.repartition("batch").write.partitionBy("batch").parquet(path)
        table = run.spark.read.schema(alignments.select("frag", "tid", "w", "frag_len", F.col("batch").cast("int").alias("batch")).schema).parquet(path)
        last = alignments.agg(F.max("batch")).first()[0]
        last = -1 if last is None else int(last)
        for b in range(last + 1):
            run(table.filter(F.col("batch") == b), b)
        return run, last
    sizes = {int(r.batch): r.n for r in columns.filter("batch is not null").groupBy("batch").agg(F.count("*").alias("n")).collect()}
    last = max(sizes, default=-1)
    pieces = F.lit(max(1, max(sizes.values(), default=0) // HITS_EACH))
    # a fragment's hits lie in one row; a batch's fragments in pieces, which are the tasks of its step
    hit = F.struct(F.col("tid").cast("long").alias("tid"), F.col("w").cast("double").alias("w"), F.col("frag_len").cast("long").alias("frag_len"))
    dealt = columns.filter("batch >= 0").withColumn("piece", F.pmod(F.xxhash64("frag"), pieces)).repartition("batch", "piece")
    dealt = dealt.groupBy("batch", "piece", "frag").agg(F.collect_list(hit).alias("hits")).select("batch", "hits")
    dealt.write.partitionBy("batch").parquet(path)
    held = _Held(run, few)
    for b in range(last + 1):
        held.step(b, run.spark.read.schema(dealt.select("hits").schema).parquet(f"{path}/batch={b}") if b in sizes else None)
        if b == last or (b + 1) % keep_each == 0:
            held.write(b)
    return run, last
