"""Abundances by expectation maximisation, its variational form, and resampling.

Members of classes are partitioned by class once and kept; in each round the
abundances, one row for each target, are joined to them (broadcast while they
are few), shares are formed within each class, and partial sums by target are
shuffled. Lineage is cut every few rounds by a table in the
shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import digamma
from ..store import new_path, stored
from .bias import due
from .classes import length_weights
from .ranks import running_sum

CUT_EVERY = 5
#: Targets up to which their abundances are broadcast: 16 bytes each.
MOST_BROADCAST = 2_000_000


def expectation_maximisation(members: DataFrame, rounds: int, start: DataFrame | None = None, prior: DataFrame | float | None = None, tolerance: float | None = None, least_rounds: int = 0, significant: float = 1e-2) -> DataFrame:
    """(tid, alpha) after ``rounds`` rounds over members (key, n, tid, w), from equal abundances or ``start``.

    prior: with it the variational form is used, with that many pseudo-counts for each target, or those of (tid, prior).
    Up to MOST_BROADCAST targets, abundances are broadcast and a round has one shuffle, of partial sums by target.
    tolerance: rounds end when no abundance above ``significant`` changes by a larger share, but not before least_rounds;
    if they never do, that is an error."""
    alpha, _, settled = em_rounds(members, rounds, start, prior, tolerance, least_rounds, significant)
    if tolerance is not None and not settled:
        raise RuntimeError("abundances did not settle")
    return alpha


def em_rounds(members: DataFrame, rounds: int, start: DataFrame | None = None, prior: DataFrame | float | None = None, tolerance: float | None = None, least_rounds: int = 0, significant: float = 1e-2) -> tuple[DataFrame, int, bool]:
    """The same, with the number of rounds made and whether abundances have settled."""
    kept = members.select("key", "n", "tid", "w").repartition("key").persist(StorageLevel.DISK_ONLY)
    alpha = start if start is not None else kept.select("tid").distinct().withColumn("alpha", F.lit(1.0))
    shares = Window.partitionBy("key")
    small = alpha.count() <= MOST_BROADCAST
    settled, i = False, 0
    for i in range(1, rounds + 1):
        if prior is None:
            theta = alpha.select("tid", F.col("alpha").alias("theta"))
        else:
            raised = alpha.join(prior, "tid").withColumn("a", F.col("alpha") + F.col("prior")) if isinstance(prior, DataFrame) else alpha.withColumn("a", F.col("alpha") + prior)
            whole = raised.agg(digamma(F.sum("a")).alias("whole"))
            theta = raised.crossJoin(F.broadcast(whole)).select("tid", F.when(F.col("a") > 1e-10, F.exp(digamma(F.col("a")) - F.col("whole"))).otherwise(0.0).alias("theta"))  # one row on the right
        joined = kept.join(F.broadcast(theta) if small else theta, "tid").withColumn("x", F.col("theta") * F.col("w"))
        given = joined.withColumn("share", F.col("n") * F.col("x") / F.nullif(F.sum("x").over(shares), F.lit(0.0)))
        new = given.groupBy("tid").agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("alpha"))
        if tolerance is not None and i >= least_rounds:
            new = stored(new, "alpha")
            change = new.alias("b").join(alpha.alias("a"), "tid").filter(F.col("b.alpha") > significant).agg(F.max(F.abs(F.col("b.alpha") - F.col("a.alpha")) / F.col("b.alpha"))).first()[0]
            alpha = new
            if change is None or change <= tolerance:
                settled = True
                break
        else:
            # the variational form reads abundances twice in a round
            alpha = stored(new, "alpha") if prior is not None or i % CUT_EVERY == 0 or i == rounds else new
    kept.unpersist()
    return alpha, i, settled


class BiasRun:
    """Expectation maximisation whose class weights are made anew once in mid run, from lengths that its own abundances
    correct: after more than ``first`` rounds, or when abundances have settled before.

    members: (key, n, tid, w) with weights of alignments alone; lengths: (tid, eff_len); correct: a function from
    (tid, alpha) to corrected lengths (tid, eff_len), or to None where there is too little to go by. prior_per_base: with it
    the variational form, with that many pseudo-counts for each base of the effective length, so priors follow lengths.
    Every phase is a table below ``folder``: a run that begins again with the same folder goes on after the last of them."""

    def __init__(self, members: DataFrame, lengths: DataFrame, correct: Callable[[DataFrame], DataFrame | None], folder: str | None = None, tolerance: float = 1e-2, first: int = 10, least_rounds: int = 100, most_rounds: int = 10_000, save_every: int = 50, prior_per_base: float | None = None) -> None:
        self.members, self.uncorrected, self.correct, self.spark = members, lengths, correct, members.sparkSession
        self.folder = folder or new_path(self.spark, "bias-run")
        self.tolerance, self.first, self.least, self.most, self.save_every, self.prior = tolerance, first, least_rounds, most_rounds, save_every, prior_per_base

    def saved(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException:
            return None  # no such table yet

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def state(self) -> tuple[DataFrame | None, int, bool, bool]:
        """(abundances, rounds made, whether they had settled, whether lengths have been corrected) of the last table."""
        marks = self.saved("marks")
        last = marks.orderBy(F.col("rounds").desc(), F.col("corrected").desc()).first() if marks is not None else None
        return (None, 0, False, False) if last is None else (self.saved(f"alpha-{last.rounds}"), last.rounds, last.settled, last.corrected)

    def mark(self, rounds: int, settled: bool, corrected: bool) -> None:
        self.spark.createDataFrame([(rounds, settled, corrected)], "rounds int, settled boolean, corrected boolean").write.mode("append").parquet(f"{self.folder}/marks")

    def go_on(self, lengths: DataFrame, least_length: float, alpha: DataFrame | None, done: int, upto: int, least: int) -> tuple[DataFrame, int, bool]:
        weighted = stored(length_weights(self.members, lengths, least_length), "bias-run-members")
        prior = per_nucleotide(lengths, self.prior) if self.prior is not None else None
        alpha, made, settled = em_rounds(weighted, upto - done, alpha, prior, self.tolerance, max(0, least - done))
        return self.save(alpha, f"alpha-{done + made}"), done + made, settled

    def lengths(self) -> DataFrame:
        """The lengths that count by now."""
        found = self.saved("lengths")
        return self.uncorrected if found is None else found

    def run(self) -> DataFrame:
        """(tid, alpha) when abundances have settled; they never do in fewer than ``least_rounds`` rounds."""
        alpha, done, settled, corrected = self.state()
        if not corrected:
            if not due(done, settled, corrected):
                alpha, done, settled = self.go_on(self.uncorrected, 1.0, alpha, done, self.first + 1, 0)
                self.mark(done, settled, False)
            new = self.correct(alpha)
            if new is not None:
                self.save(new, "lengths")
            self.mark(done, False, True)
        lengths = self.lengths()
        least_length = 1.0 if self.saved("lengths") is None else 0.0
        settled = settled and corrected
        while not settled and done < self.most:
            alpha, done, settled = self.go_on(lengths, least_length, alpha, done, min(self.most, done + self.save_every), self.least)
            self.mark(done, settled, True)
        if not settled:
            raise RuntimeError("abundances did not settle")
        return alpha


def truncate(alpha: DataFrame, least: float = 1e-8) -> DataFrame:
    """Abundances up to ``least`` become 0."""
    return alpha.withColumn("alpha", F.when(F.col("alpha") <= least, 0.0).otherwise(F.col("alpha")))


def start(projected: DataFrame, required: float = 5e7, most: float = 0.999, own: DataFrame | None = None) -> DataFrame:
    """(tid, alpha) to begin with, of (tid, projected): a mixture of these counts and of an even share.

    The more fragments there are next to ``required``, the more the counts weigh. own (tid, unique_count, eff_len): the
    share is not even but (unique_count + 0.5) eff_len / 1000."""
    whole = projected.agg(F.sum("projected").alias("whole"), F.count("*").alias("targets"))
    f = F.least(F.lit(most), F.col("whole") / required)
    rows = projected.crossJoin(F.broadcast(whole))  # one row on the right
    even = F.col("whole") / F.col("targets")
    if own is not None:
        rows, even = rows.join(own, "tid"), (F.col("unique_count") + 0.5) * F.col("eff_len") / 1000
    return rows.select("tid", (F.col("projected") * f + even * (1 - f)).alias("alpha"))


def per_nucleotide(lengths: DataFrame, prior: float = 1e-5) -> DataFrame:
    """(tid, prior) for expectation_maximisation: pseudo-counts by effective length."""
    return lengths.select("tid", (F.col("eff_len") * prior).alias("prior"))


def blocks_of(members: DataFrame, classes_each: int = 50_000) -> int:
    return max(1, -(-members.select("key").distinct().count() // classes_each))


def resample(counts: DataFrame, draws: int, seed: int = 1, classes_each: int = 50_000) -> DataFrame:
    """(sample_id, key, n): multinomial draws from classes (key, n), each with the same total as these.

    Classes fall into blocks by a hash. The totals of the blocks are drawn first, one number for each block and draw, and
    then the classes' counts within each block, given its total; both together are one multinomial draw over all classes."""
    blocks = max(1, -(-counts.count() // classes_each))
    dealt = stored(counts.select("key", F.col("n").cast("long").alias("n"), F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block")), "classes-dealt")
    sums = {r.block: r.n for r in dealt.groupBy("block").agg(F.sum("n").alias("n")).collect()}  # a row for 50,000 classes
    whole, names = sum(sums.values()), sorted(sums)
    if not whole:
        return dealt.select(F.lit(0).alias("sample_id"), "key", "n").limit(0)
    drawn = np.random.default_rng(seed).multinomial(whole, np.array([sums[b] for b in names]) / whole, draws)
    totals = counts.sparkSession.createDataFrame([(d, b, int(drawn[d, i])) for d in range(draws) for i, b in enumerate(names)], "sample_id int, block int, total long")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        n = pdf["n"].to_numpy()
        got = np.random.default_rng([seed, int(key[0]), int(key[1])]).multinomial(int(pdf["total"].iloc[0]), n / n.sum())
        return pd.DataFrame({"sample_id": key[0], "key": pdf["key"], "n": got})

    return dealt.join(F.broadcast(totals), "block").filter("n > 0").groupBy("sample_id", "block").applyInPandas(run, "sample_id int, key string, n long")


def bootstrap(members: DataFrame, draws: int, rounds: int = 50, seed: int = 1) -> DataFrame:
    """(sample_id, tid, alpha): abundances of classes whose counts are drawn anew, with the same total.

    Counts are multinomial draws (see resample); one grouped round then serves all draws at once."""
    drawn = resample(members.groupBy("key").agg(F.max("n").alias("n")), draws, seed)
    kept = stored(members.select("key", "tid", "w").join(drawn.filter("n > 0"), "key"), "bootstrap-members").repartition("sample_id", "key").persist(StorageLevel.DISK_ONLY)
    alpha = kept.select("sample_id", "tid").distinct().withColumn("alpha", F.lit(1.0))
    shares = Window.partitionBy("sample_id", "key")
    few = members.select("tid").distinct().count() * draws <= MOST_BROADCAST
    for i in range(1, rounds + 1):
        given = kept.join(F.broadcast(alpha) if few else alpha, ["sample_id", "tid"]).withColumn("x", F.col("alpha") * F.col("w"))
        given = given.withColumn("share", F.col("n") * F.col("x") / F.nullif(F.sum("x").over(shares), F.lit(0.0)))
        alpha = given.groupBy("sample_id", "tid").agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("alpha"))
        if i % CUT_EVERY == 0 or i == rounds:
            alpha = stored(alpha, "bootstrap-alpha")
    kept.unpersist()
    return alpha


def gibbs_prior(prior: float = 1e-3, variational: bool = False, lengths: bool = False) -> float:
    """Pseudo-counts of a target: 1e-3 after plain rounds; after variational ones no less than 1, or than 1e-3 a nucleotide."""
    return max(prior, 1e-3 if lengths else 1.0) if variational else 1e-3


def deal_classes(cls: np.ndarray, n: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A multinomial draw for every class at once: cls is ascending, n and p are those of each member.

    By conditional binomials: the i-th members of all classes draw together from what the members before them left."""
    new = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
    size = np.diff(np.append(new, len(cls)))
    left, whole = n[new].copy(), np.add.reduceat(p, new)
    out = np.zeros(len(cls), np.int64)
    for i in range(size.max(initial=0)):
        own = np.flatnonzero(size > i)
        at = new[own] + i
        share = np.where(whole[own] > 0, np.clip(p[at] / np.where(whole[own] > 0, whole[own], 1), 0, 1), 0)
        last = size[own] == i + 1
        out[at] = np.where(last & (whole[own] > 0), left[own], rng.binomial(left[own], share))
        left[own] -= out[at]
        whole[own] = np.maximum(whole[own] - p[at], 0)
    return out


def _hashed(*parts: np.ndarray | int) -> np.ndarray:
    """Numbers above 0 and below 1 that depend on the given ones alone."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for x in parts:
            h = h ^ (np.asarray(x).astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
            h = h ^ (h >> np.uint64(31))
    return ((h >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)


def hashed_gamma(shape: np.ndarray, *key: np.ndarray | int) -> np.ndarray:
    """Draws of gamma distributions of scale 1, each fixed by its key, all at once: squeezed normal draws, tried anew with
    the next number of the key where they are refused."""
    shape = np.asarray(shape, float)
    key = tuple(np.broadcast_to(np.asarray(k), shape.shape) for k in key)
    small = shape < 1
    d = np.where(small, shape + 1, shape) - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out, left, attempt = np.zeros(len(shape)), np.arange(len(shape)), 0
    while len(left):
        own = tuple(k[left] for k in key)
        x = np.sqrt(-2 * np.log(_hashed(*own, attempt, 1))) * np.cos(2 * np.pi * _hashed(*own, attempt, 2))
        v = (1 + c[left] * x) ** 3
        good = (v > 0) & (np.log(_hashed(*own, attempt, 3)) < 0.5 * x**2 + d[left] * (1 - v + np.log(np.where(v > 0, v, 1))))
        out[left[good]] = (d[left] * v)[good]
        left, attempt = left[~good], attempt + 1
    return np.where(small, out * _hashed(*key, -1, 4) ** (1 / np.where(small, shape, 1)), out)


def gibbs(members: DataFrame, chains: int, kept_draws: int, thinning: int = 16, prior: float | DataFrame = 1.0, seed: int = 1, lengths: DataFrame | None = None, rescaled: bool = False, begin: DataFrame | None = None) -> DataFrame:
    """(sample_id, tid, alpha) by Gibbs sampling: counts of every ``thinning``-th round of each chain.

    In a round every target draws its rate from a gamma distribution, with 0.1 and its effective length (tid, eff_len; 1
    if not given) as inverse scale, and every class deals its fragments by rate and weight; where all of these are 0, by
    1 / eff_len. prior: pseudo-counts, one number or (tid, prior). begin: (tid, alpha) to start from, else by weights.
    rescaled: instead of counts rates times lengths, scaled to the number of fragments.

    Members are dealt by class into blocks of some ten thousand classes, once; rates, one row a target with a number for
    each chain, go to them by broadcast while they are few, so a round shuffles sums by target alone. Draws depend on seed,
    chain, round and block or target, so a lost task draws the same again."""
    blocks = blocks_of(members, 20_000)
    inverse = members.select("tid").distinct().withColumn("eff_len", F.lit(1.0)) if lengths is None else lengths.select("tid", F.col("eff_len").cast("double").alias("eff_len"))
    extra = F.lit(float(prior)).alias("prior") if not isinstance(prior, DataFrame) else None
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block")
    rows = members.select("key", F.col("n").cast("long").alias("n"), F.col("tid").cast("long").alias("tid"), F.col("w").cast("double").alias("w"), block).join(inverse.select(F.col("tid").cast("long").alias("tid"), "eff_len"), "tid")
    each = rows.repartition(blocks, "block").sortWithinPartitions("block", "key", "tid").persist(StorageLevel.DISK_ONLY)
    first = begin.select(F.col("tid").cast("long").alias("tid"), "alpha") if begin is not None else each.groupBy("tid").agg(F.sum(F.col("w") * F.col("n")).alias("alpha"))
    whole = float(each.select("key", "n").distinct().agg(F.sum("n")).first()[0] or 0)
    base = first.join(each.select("tid", "eff_len").distinct(), "tid", "right").na.fill(0.0, ["alpha"])
    base = base.withColumn("prior", extra) if extra is not None else base.join(prior.select(F.col("tid").cast("long").alias("tid"), "prior"), "tid")
    state = stored(base.select("tid", "eff_len", "prior", F.array_repeat(F.col("alpha").cast("double"), chains).alias("alpha")), "gibbs-state")
    few = state.count() * chains <= MOST_BROADCAST

    def draw_rates(i: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                alpha = np.stack(pdf["alpha"].to_list()) if len(pdf) else np.zeros((0, chains))
                shape = alpha + pdf["prior"].to_numpy()[:, None]
                tid, chain = np.repeat(pdf["tid"].to_numpy(), chains), np.tile(np.arange(chains), len(pdf))
                mu = hashed_gamma(shape.ravel(), seed, i, chain, tid).reshape(-1, chains) / (0.1 + pdf["eff_len"].to_numpy())[:, None]
                yield pd.DataFrame({"tid": pdf["tid"], "mu": list(mu)})

        return run

    def deal_blocks(i: int):
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["key", "tid"])
            cls = np.cumsum(np.append(True, pdf["key"].to_numpy()[1:] != pdf["key"].to_numpy()[:-1])) - 1
            n, w, eff, mu = pdf["n"].to_numpy(), pdf["w"].to_numpy(), pdf["eff_len"].to_numpy(), np.stack(pdf["mu"].to_list())
            sums = np.zeros((len(pdf), chains), np.int64)
            for c in range(chains):
                p = mu[:, c] * w
                none = np.bincount(cls, p) <= 0
                p = np.where(none[cls], 1 / np.maximum(eff, 1e-300), p)
                sums[:, c] = deal_classes(cls, n, p, np.random.default_rng([seed, i, c, int(pdf["block"].iloc[0]), 7]))
            tid, at = np.unique(pdf["tid"].to_numpy(), return_inverse=True)
            got = np.stack([np.bincount(at, sums[:, c], len(tid)) for c in range(chains)], axis=1)
            return pd.DataFrame({"tid": np.repeat(tid, chains), "chain": np.tile(np.arange(chains, dtype=np.int32), len(tid)), "got": got.ravel()})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            for pdf in batches:
                for _, part in pdf.groupby("block", sort=False):
                    if held and held[0]["block"].iloc[0] != part["block"].iloc[0]:
                        yield one(pd.concat(held))
                        held = []
                    held.append(part)
            if held:
                yield one(pd.concat(held))

        return run

    out = None
    for i in range(kept_draws * thinning):
        mu = stored(state.mapInPandas(draw_rates(i), "tid long, mu array<double>"), "gibbs-rates")
        near = each.join(F.broadcast(mu), "tid") if few else each.join(mu, "tid").repartition(blocks, "block").sortWithinPartitions("block", "key", "tid")
        dealt = near.select("block", "key", "tid", "n", "w", "eff_len", "mu").mapInPandas(deal_blocks(i), "tid long, chain int, got double").groupBy("tid", "chain").agg(F.sum("got").alias("got"))
        wide = dealt.groupBy("tid").agg(*(F.sum(F.when(F.col("chain") == c, F.col("got"))).alias(f"c{c}") for c in range(chains)))
        joined = state.select("tid", "eff_len", "prior").join(wide, "tid", "left")
        state = stored(joined.select("tid", "eff_len", "prior", F.array(*(F.coalesce(f"c{c}", F.lit(0.0)) for c in range(chains))).alias("alpha")), "gibbs-state")
        if (i + 1) % thinning == 0:
            if rescaled:
                rates = mu.join(state.select("tid", "eff_len"), "tid").select("tid", F.transform("mu", lambda m: m * F.col("eff_len")).alias("x"))
                totals = rates.agg(*(F.sum(F.col("x")[c]).alias(f"s{c}") for c in range(chains))).first()
                draw = rates.select("tid", F.array(*(F.col("x")[c] * (whole / totals[c] if totals[c] else 0.0) for c in range(chains))).alias("alpha"))
            else:
                draw = state.select("tid", "alpha")
            draw = draw.select(F.col("tid").cast(members.schema["tid"].dataType).alias("tid"), F.posexplode("alpha").alias("chain", "alpha"))
            draw = draw.select((F.col("chain") * kept_draws + i // thinning).cast("int").alias("sample_id"), "tid", "alpha")
            out = draw if out is None else out.unionByName(draw)
    each.unpersist()
    return out


def chains_for(draws: int) -> int:
    """Chains that share a number of draws."""
    return next(c for c, least in ((8, 200), (4, 100), (2, 50), (1, 0)) if draws >= least)


def posterior_draws(members: DataFrame, draws: int, lengths: DataFrame, begin: DataFrame | None = None, thinning: int = 16, prior: float = 1e-3, variational: bool = False, by_base: bool = False, rescaled: bool = True, seed: int = 1) -> DataFrame:
    """``draws`` draws by Gibbs sampling after a run of expectation maximisation, (sample_id, tid, alpha).

    prior: that of the run if it was variational, for each target or, with by_base, each base of its effective length."""
    value = gibbs_prior(prior, variational, by_base)
    each = per_nucleotide(lengths, value) if variational and by_base else value
    chains = chains_for(draws)
    got = gibbs(members, chains, -(-draws // chains), thinning, each, seed, lengths, rescaled, begin)
    return got.filter(F.col("sample_id") < draws)


def forgetting_mass(batches: DataFrame, factor: float = 0.65) -> DataFrame:
    """``batches`` (batch, from 1) with log_mass: each batch's weight in a one-pass estimate, as a running sum."""
    i = F.col("batch").cast("double")
    step = F.when(i > 1, factor * F.log(F.greatest(i - 1, F.lit(1.0))) - F.log(F.nullif(F.pow(i, F.lit(factor)) - 1, F.lit(0.0)))).otherwise(0.0)
    return running_sum(batches, "batch", step, "log_mass")


def posterior_sample(posteriors: DataFrame, seed: int = 1) -> DataFrame:
    """One alignment of each fragment, drawn by its posterior p: the first whose running sum exceeds a hash of the fragment."""
    digest = F.substring(F.md5(F.concat_ws(":", F.col("frag").cast("string"), F.lit(str(seed))).cast("binary")), 1, 8)
    u = (F.conv(digest, 16, 10).cast("double") + 0.5) / float(1 << 32)
    run = F.sum("p").over(Window.partitionBy("frag").orderBy("tid").rowsBetween(Window.unboundedPreceding, 0))
    last = F.max("tid").over(Window.partitionBy("frag"))
    hit = posteriors.withColumn("cum", run).withColumn("__last", last).filter((F.col("cum") > u) | (F.col("tid") == F.col("__last")))
    return hit.groupBy("frag").agg(F.min_by(F.struct("tid", "p"), "tid").alias("x")).select("frag", "x.tid", "x.p")
