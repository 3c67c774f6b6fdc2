"""From k-mers to alignments: index, seeds, mates, and the choice of alignments."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.sequences import reverse_complement
from ..store import stored
from .kmers import kmer_places, stranded_places
from .slices import target_blocks, with_slices

MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND, BAND, LEAST_SCORE = 2, -4, 6, 2, 15, 0.65  # fixed values: default scoring


@dataclass(frozen=True)
class ScoreRules:
    """match, mismatch, gap_open, gap_extend: what letters and gaps earn and cost. band: how far alignments may leave the
    diagonal. least: share of a perfect score that counts. consensus: share of the read's best target that a chain needs.
    most_places: places beyond which a fragment has none. orphans: whether mates alone count. clip_ends: whether letters
    beyond a target's ends are clipped."""

    match: int = MATCH
    mismatch: int = MISMATCH
    gap_open: int = GAP_OPEN
    gap_extend: int = GAP_EXTEND
    band: int = BAND
    least: float = LEAST_SCORE
    consensus: float = 0.65
    most_places: int = 200
    orphans: bool = True
    clip_ends: bool = False


#: Rules like those of a well-known aligner, and strict ones that know hardly any gaps.
PRESETS = {
    "default": ScoreRules(),
    "aligner": ScoreRules(gap_open=5, gap_extend=3, consensus=0.5, most_places=1000, orphans=False),
    "strict": ScoreRules(match=1, mismatch=0, gap_open=25, gap_extend=25, least=0.8, consensus=0.5, most_places=1000, orphans=False),
}


def distinct_targets(targets: DataFrame) -> DataFrame:
    """Targets (tid, seq) without exact duplicates; the smallest tid of a sequence stays."""
    kept = targets.groupBy(F.sha2("seq", 256).alias("sha")).agg(F.min("tid").alias("tid")).select("tid")
    return targets.join(kept, "tid", "left_semi")


def kmer_index(targets: DataFrame, k: int) -> DataFrame:
    """(kmer, tid, pos) of every k-mer, as a number, of every target of at least k letters; k is odd and at most 31."""
    return kmer_places(targets, "tid", k)


#: K-mers with too many places up to which their list is broadcast (8 bytes each); longer lists are shuffled.
MOST_BROADCAST = 1_000_000


def seed_hits(reads: DataFrame, index: DataFrame, k: int, most_places: int = 1000) -> DataFrame:
    """(frag, rpos, tid, pos): places of the reads' k-mers; k-mers with more than ``most_places`` places give none.

    Such k-mers leave the index before the join, so that their places are never shuffled with the reads."""
    return kmer_places(reads, "frag", k, "rpos").join(rare_kmers(index, most_places), "kmer").select("frag", "rpos", "tid", "pos")


def rare_kmers(index: DataFrame, most_places: int) -> DataFrame:
    """The index without k-mers that have more than ``most_places`` places."""
    index = stored(index, "kmer-index")
    often = stored(index.groupBy("kmer").agg(F.count("*").alias("places")).filter(F.col("places") > most_places).select("kmer"), "kmers-often")
    few = F.broadcast(often) if often.count() <= MOST_BROADCAST else often
    return index.join(few, "kmer", "left_anti")


def stranded_hits(reads: DataFrame, targets: DataFrame, k: int, most_places: int = 1000) -> DataFrame:
    """(frag, tid, fwd, rpos, pos): places that reads (frag, seq) and targets (tid, seq) share, on both strands.

    Of a reverse hit rpos counts along the read's reverse complement, so on either strand both places grow together."""
    return _stranded(reads, stranded_index(targets, k, most_places), k)


def stranded_index(targets: DataFrame, k: int, most_places: int = 1000) -> DataFrame:
    return rare_kmers(stranded_places(targets, "tid", k), most_places)


def _stranded(reads: DataFrame, index: DataFrame, k: int) -> DataFrame:
    hits = stranded_places(reads, "frag", k, "rpos").join(index.select("kmer", "tid", "pos", F.col("fwd").alias("up")), "kmer")
    same = F.col("fwd") == F.col("up")
    return hits.select("frag", "tid", same.alias("fwd"), F.when(same, F.col("rpos")).otherwise(F.col("length") - k - F.col("rpos")).alias("rpos"), "pos")


#: Hits that are shuffled at once where reads go in rounds: 3 bytes each on disk for counts, 17 for chains with gaps.
ROUND_HITS = 150_000_000


def in_rounds(reads: DataFrame, index: DataFrame, k: int, then: Callable[[DataFrame], DataFrame], stranded: bool = False, most_hits: int | None = None) -> DataFrame:
    """``then`` of the hits of reads (frag, seq) on an index without frequent k-mers, for a ``then`` that takes each read by
    itself. Where there are many hits the reads go in rounds, by a hash of frag: a round's results are stored and its
    shuffle files removed before the next one, so the hits that lie on disk at once don't grow with the reads.

    The number of rounds comes from the hits of every 64th k-mer; whatever it is, the results are the same."""
    most_hits = ROUND_HITS if most_hits is None else most_hits
    places = lambda r: (stranded_places if stranded else kmer_places)(r, "frag", k, "rpos")
    made = (lambda r: _stranded(r, index, k)) if stranded else lambda r: places(r).join(index, "kmer").select("frag", "rpos", "tid", "pos")
    count = lambda rows, name: rows.filter(F.pmod(F.xxhash64("kmer"), F.lit(64)) == 0).groupBy("kmer").agg(F.count("*").alias(name))
    hits = 64 * (count(places(reads), "r").join(count(index, "t"), "kmer").agg(F.sum(F.col("r") * F.col("t"))).first()[0] or 0)
    rounds = -(-hits // most_hits)
    if rounds < 2:
        return then(made(reads))
    own = F.pmod(F.xxhash64("frag"), F.lit(rounds))
    return reduce(DataFrame.unionByName, [stored(then(made(reads.filter(own == i))), "hits-round") for i in range(rounds)])


def chains(hits: DataFrame) -> DataFrame:
    """(frag, tid, diagonal, seeds, first, last): seeds of a read on one diagonal of a target, the collinear chains without gaps."""
    diagonal = F.col("pos") - F.col("rpos")
    return hits.groupBy("frag", "tid", diagonal.alias("diagonal")).agg(F.count("*").alias("seeds"), F.min("rpos").alias("first"), F.max("rpos").alias("last"))


def gapped_chains(hits: DataFrame, k: int, most_length: int, most_shift: int = 15) -> DataFrame:
    """(frag, tid, chain, seeds, bases, first, last, start, stop): collinear chains with gaps.

    First the seeds of a read follow one another on each diagonal of a target, by windows: runs of seeds no further than
    ``most_length`` apart. Runs then join along the target while the diagonal moves by ``most_shift`` at most, place in
    read and target both grow and the whole stays within ``most_length``. bases: letters of the read that seeds cover."""
    on = Window.partitionBy("frag", "tid", "diagonal").orderBy("rpos")
    rows = hits.repartition("frag", "tid").withColumn("diagonal", F.col("pos") - F.col("rpos"))  # serves all steps below
    gap = F.col("rpos") - F.lag("rpos").over(on)
    rows = rows.withColumn("new", F.when(gap <= most_length, 0).otherwise(1)).withColumn("covered", F.least(F.coalesce(gap, F.lit(k)), F.lit(k)))
    rows = rows.withColumn("run", F.sum("new").over(on.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("frag", "tid", "diagonal", "run").agg(F.count("*").alias("seeds"), F.sum("covered").alias("bases"), F.min("rpos").alias("first"), (F.max("rpos") + k).alias("last"))
    along = Window.partitionBy("frag", "tid").orderBy(F.col("first") + F.col("diagonal"), "first")
    before = lambda c: F.lag(c).over(along)
    apart = (F.abs(F.col("diagonal") - before("diagonal")) > most_shift) | (F.col("first") <= before("first")) | (F.col("last") + F.col("diagonal") - before("first") - before("diagonal") > most_length)
    runs = runs.withColumn("over", F.greatest(before("last") - F.col("first"), F.lit(0))).withColumn("new", F.when(apart | before("first").isNull(), 1).otherwise(0))
    runs = runs.withColumn("chain", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    bases = F.sum(F.col("bases") - F.when(F.col("new") == 1, 0).otherwise(F.least("over", "bases")))
    return runs.groupBy("frag", "tid", "chain").agg(F.sum("seeds").alias("seeds"), bases.alias("bases"), F.min("first").alias("first"), F.max("last").alias("last"), F.min(F.col("first") + F.col("diagonal")).alias("start"), F.max(F.col("last") + F.col("diagonal")).alias("stop"))


def consensus_filter(chains: DataFrame, share: float = 0.65, of_best: float = 0.75, when: str = "both") -> DataFrame:
    """Chains that are good enough, before (``share`` of the read's best target), after (``of_best`` of the target's best
    chain), both or none. For reads without mates both thresholds are usually 1."""
    if when not in ("before", "after", "both", "none"):
        raise ValueError(f"{when!r} is none of before, after, both, none")
    out = chains
    if when in ("before", "both"):
        out = out.withColumn("__t", F.max("bases").over(Window.partitionBy("frag"))).filter(F.col("bases") >= F.col("__t") * share).drop("__t")
    if when in ("after", "both"):
        out = out.withColumn("__t", F.max("bases").over(Window.partitionBy("frag", "tid"))).filter(F.col("bases") >= F.col("__t") * of_best).drop("__t")
    return out


def dovetails(fwd_start: Column, rev_end: Column, rev_start: Column) -> Column:
    """Whether mates on opposite strands run past each other: the reverse one begins before the forward one."""
    return (rev_start < fwd_start) & (rev_end >= fwd_start)


def best_decoys(best: DataFrame) -> DataFrame:
    """For fragments whose best alignment is to decoys alone: the decoys that are equally good."""
    w = Window.partitionBy("frag")
    target, decoy = F.max(F.when(~F.col("decoy"), F.col("score"))).over(w), F.max(F.when(F.col("decoy"), F.col("score"))).over(w)
    rows = best.withColumn("__t", target).withColumn("__d", decoy).filter(F.col("decoy") & (F.col("score") == F.col("__d")))
    return rows.filter(F.col("__t").isNull() | (F.col("__t") < F.col("__d"))).drop("__t", "__d")


def read_statistics(reads: DataFrame, k: int) -> DataFrame:
    """One row: reads, shortest, too_short (below k), all_too_short."""
    n = reads.agg(F.count("*").alias("reads"), F.min(F.length("seq")).alias("shortest"), F.count_if(F.length("seq") < k).alias("too_short"))
    return n.withColumn("all_too_short", (F.col("reads") > 0) & (F.col("reads") == F.col("too_short")))


def sketch_map(hits: DataFrame) -> DataFrame:
    """(frag, tid, hits): targets that hold the most of a read's k-mers, all of those with as many."""
    n = hits.groupBy("frag", "tid").agg(F.countDistinct("rpos").alias("hits"))
    top = n.groupBy("frag").agg(F.max("hits").alias("top"))
    return n.join(top, "frag").filter("hits = top").select("frag", "tid", "hits")


def sketch_strands(hits: DataFrame, k: int, stretch: float = 1.25) -> DataFrame:
    """(frag, tid, fwd, hits): targets and strands that hold the most of a read's k-mers, of stranded hits.

    Of a place in the read the first one in the target counts, and only if it lies behind all before it; a target on which
    the places spread over more than ``stretch`` times what they do in the read, and a k-mer, is none."""
    one = hits.groupBy("frag", "tid", "fwd", "rpos").agg(F.min("pos").alias("pos"))
    before = F.max("pos").over(Window.partitionBy("frag", "tid", "fwd").orderBy("rpos").rowsBetween(Window.unboundedPreceding, -1))
    rising = one.withColumn("__b", before).filter(F.col("__b").isNull() | (F.col("pos") > F.col("__b")))
    wide = lambda c: F.max(c) - F.min(c)
    n = rising.groupBy("frag", "tid", "fwd").agg(F.count("*").alias("hits"), wide("pos").alias("__p"), wide("rpos").alias("__r"))
    n = n.filter(F.col("__p") <= F.col("__r") * stretch + k).drop("__p", "__r")
    return n.withColumn("__t", F.max("hits").over(Window.partitionBy("frag"))).filter("hits = __t").drop("__t")


def join_mates(left: DataFrame, right: DataFrame, most_length: int) -> DataFrame:
    """Pairs of left and right alignments (frag, tid, pos, fwd) of a fragment on one target, on different strands and
    within a fragment length. Both sides are joined on fragment and target; the distance is checked within these."""
    r = right.select("frag", "tid", F.col("pos").alias("mate_pos"), F.col("fwd").alias("mate_fwd"))
    near = (F.col("fwd") != F.col("mate_fwd")) & (F.abs(F.col("pos") - F.col("mate_pos")) <= most_length)
    return left.join(r, ["frag", "tid"]).filter(near)


def joint_hits(left: DataFrame, right: DataFrame, most_length: int, of_best_pair: float = 0.9, of_best_orphan: float = 0.95) -> DataFrame:
    """(frag, tid, kind, pos, fwd, mate_pos, mate_fwd, score, tag) of left and right alignments (frag, tid, pos, fwd, score).

    Pairs lie on one target, on different strands and within a fragment length, and score what both do; those with
    ``of_best_pair`` of the fragment's best are kept (kind pair). Fragments without a pair keep single mates with
    ``of_best_orphan`` of their best one (left, right). tag says what became of the fragment: paired, only_left,
    only_right, or apart, if both mates lie somewhere and nowhere together."""
    r = right.select("frag", "tid", F.col("pos").alias("mate_pos"), F.col("fwd").alias("mate_fwd"), F.col("score").alias("mate_score"))
    near = (F.col("fwd") != F.col("mate_fwd")) & (F.abs(F.col("pos") - F.col("mate_pos")) <= most_length)
    columns = ["frag", "tid", "kind", "pos", "fwd", "mate_pos", "mate_fwd", "score"]
    pairs = left.join(r, ["frag", "tid"]).filter(near).withColumn("score", F.col("score") + F.col("mate_score")).withColumn("kind", F.lit("pair")).select(columns)
    own = Window.partitionBy("frag")
    pairs = stored(pairs, "pairs")
    alone = left.select("frag", "tid", F.lit("left").alias("kind"), "pos", "fwd", F.lit(None).cast("int").alias("mate_pos"), F.lit(None).cast("boolean").alias("mate_fwd"), "score")
    alone = alone.unionByName(r.select("frag", "tid", F.lit("right").alias("kind"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("boolean").alias("fwd"), "mate_pos", "mate_fwd", F.col("mate_score").alias("score")))
    alone = alone.join(pairs.select("frag").distinct(), "frag", "left_anti")
    found = lambda k: F.max(F.col("kind") == k).over(own)
    tag = F.when(found("left") & found("right"), "apart").when(found("left"), "only_left").otherwise("only_right")
    alone = alone.withColumn("tag", tag).withColumn("__t", F.max("score").over(own)).filter(F.col("score") >= F.col("__t") * of_best_orphan)
    best = pairs.withColumn("tag", F.lit("paired")).withColumn("__t", F.max("score").over(own)).filter(F.col("score") >= F.col("__t") * of_best_pair)
    return best.drop("__t").unionByName(alone.drop("__t"))


def fits_library(strand: str) -> Column:
    """Whether a joint hit agrees with a library's strand before it is aligned: U, SA (the left mate forward) or AS. Without
    a strand orphans always do, and pairs whose mates lie on different strands."""
    left, fwd, mate_fwd = F.col("kind") == "left", F.col("fwd"), F.col("mate_fwd")
    if strand == "U":
        return F.when(F.col("kind") == "pair", fwd != mate_fwd).otherwise(True)
    if strand not in ("SA", "AS"):
        raise ValueError(f"{strand!r} is none of U, SA, AS")
    ahead = F.lit(strand == "SA")
    return F.when(F.col("kind") == "pair", (fwd == ahead) & (mate_fwd != ahead)).when(left, fwd == ahead).otherwise(mate_fwd != ahead)


def orphans(one: DataFrame, pairs: DataFrame) -> DataFrame:
    """Alignments of fragments that have no pair."""
    return one.join(pairs.select("frag").distinct(), "frag", "left_anti")


def best_per_target(alignments: DataFrame, compatible: Column) -> DataFrame:
    """The best alignment of a fragment to each target: by score, then compatible first, then the later one."""
    order = Window.partitionBy("frag", "tid").orderBy(F.col("score").desc(), compatible.desc(), F.col("ln").desc())
    return alignments.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def decoy_filter(best: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Alignments to targets with at least ``threshold`` times the score of the fragment's best decoy."""
    w = Window.partitionBy("frag")
    top = F.max(F.when(F.col("decoy"), F.col("score"))).over(w)
    return best.withColumn("__d", top).filter(~F.col("decoy") & (F.col("__d").isNull() | (F.col("score") >= F.col("__d") * threshold))).drop("__d")


def soft_filter(best: DataFrame, sharpness: float = 1.0, least: float = 1e-5) -> DataFrame:
    """With p = exp(-sharpness (best - score)) of each alignment; those with a smaller p than ``least`` go."""
    top = F.max("score").over(Window.partitionBy("frag"))
    return best.withColumn("p", F.exp((F.col("score") - top) * sharpness)).filter(F.col("p") >= least)


def hard_filter(best: DataFrame) -> DataFrame:
    """Alignments as good as the fragment's best."""
    return best.withColumn("__t", F.max("score").over(Window.partitionBy("frag"))).filter("score = __t").drop("__t")


def most_places_filter(best: DataFrame, most: int) -> DataFrame:
    """Alignments of fragments with at most ``most`` of them."""
    return best.withColumn("__n", F.count("*").over(Window.partitionBy("frag"))).filter(F.col("__n") <= most).drop("__n")


def distinct_joint_hits(pairs: DataFrame, keys: list[str], coverage: str) -> DataFrame:
    """Of joint hits alike in ``keys`` the highest coverage."""
    return pairs.groupBy(*keys).agg(F.max(coverage).alias(coverage))


def mapping_type(has_pair: Column, has_left: Column, has_right: Column, only_decoy: Column) -> Column:
    """Reason code: p paired, d decoy only, m1 and m2 one mate mapped, m12 both mapped but apart, u unmapped."""
    code = F.when(only_decoy, "d").when(has_pair, "p").when(has_left & has_right, "m12").when(has_left, "m1").when(has_right, "m2")
    return code.otherwise("u")


def _padded(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts as rows of one array, and their lengths."""
    raw = [t.encode() for t in texts]
    size = np.array([len(t) for t in raw], np.int64)
    out = np.full((len(raw), max(1, size.max(initial=0))), fill, np.uint8)
    inside = np.arange(out.shape[1]) < size[:, None]
    out[inside] = np.frombuffer(b"".join(raw), np.uint8)
    return out, size


def banded_scores(reads: list[str], targets: list[str], band: int | None = None, rules: ScoreRules = ScoreRules()) -> np.ndarray:
    """Best scores of global alignments of reads to targets within a band, with affine gaps; all pairs at once.

    A row of the table for each letter of the reads holds the cells of the band only, by their distance from the main
    diagonal; gaps along a row come from a running maximum."""
    band = rules.band if band is None else band
    q, n = _padded(reads, 1)
    t, m = _padded(targets, 2)
    low, width = -(10**8), np.maximum(band, np.abs(n - m))[:, None]
    wide = int(width.max(initial=band))
    off = np.arange(-wide, wide + 1, dtype=np.int32)
    t = np.pad(t, ((0, 0), (wide + 1, max(0, q.shape[1] - t.shape[1]) + wide + 1)), constant_values=2)
    within = np.abs(off) <= width
    best = np.where(off == 0, 0, np.where((off > 0) & within & (off <= m[:, None]), -(rules.gap_open + rules.gap_extend * off), low)).astype(np.int32)
    gap_t = np.full(best.shape, low, np.int32)
    rows = np.arange(len(n))
    last = np.clip(m - n, -wide, wide) + wide
    out = np.where(n == 0, best[rows, last], low)
    for i in range(1, int(n.max(initial=0)) + 1):
        j = off + i
        inside = within & (j <= m[:, None]) & (j >= 1)
        gap_t[:, :-1] = np.maximum(best[:, 1:] - rules.gap_open, gap_t[:, 1:]) - rules.gap_extend  # the cell above lies one further right
        gap_t[:, -1] = low
        pair = np.where(q[:, i - 1 : i] == t[:, i : i + len(off)], np.int32(rules.match), np.int32(rules.mismatch))
        new = np.where(inside, np.maximum(best + pair, gap_t), low)
        if i <= wide:
            new[:, wide - i] = np.where(i <= width[:, 0], -(rules.gap_open + rules.gap_extend * i), low)
        gap_t = np.where(inside | (j == 0), gap_t, low).astype(np.int32)
        along = np.maximum.accumulate(new + rules.gap_extend * j, axis=1)
        new[:, 1:] = np.where(inside[:, 1:], np.maximum(new[:, 1:], along[:, :-1] - rules.gap_open - rules.gap_extend * j[1:]), new[:, 1:])
        best = new.astype(np.int32)
        ends = np.flatnonzero(n == i)
        out[ends] = best[ends, last[ends]]
    return out


def banded_score(read: str, target: str, band: int | None = None) -> int:
    return int(banded_scores([read], [target], band)[0])


def score_alignments(candidates: DataFrame, pairs_each: int = 2_000, rules: ScoreRules = ScoreRules()) -> DataFrame:
    """Candidates (frag, tid, pos, read, target and others) with score instead of read and target: target is the part
    that the read may lie on. Pairs of like length are scored together."""
    kept = [f for f in candidates.schema.fields if f.name not in ("read", "target")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["read"].str.len()
            pdf = pdf.iloc[np.lexsort(((pdf["target"].str.len() - size).abs(), size))]
            found = [banded_scores(pdf["read"].iloc[a : a + pairs_each].tolist(), pdf["target"].iloc[a : a + pairs_each].tolist(), rules=rules) for a in range(0, len(pdf), pairs_each)]
            pdf = pdf[[f.name for f in kept]].copy()
            pdf["score"] = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
            yield pdf

    return candidates.mapInPandas(run, T.StructType([*kept, T.StructField("score", T.IntegerType())]))


def score_chains(chains: DataFrame, reads: DataFrame, targets: DataFrame, rules: ScoreRules = ScoreRules()) -> DataFrame:
    """Chains (frag, tid, fwd, first, last, start, stop) that score well, with pos and score of the whole read on the part
    of the target where the chain puts it. reads (frag, seq), targets (tid, seq); targets travel as slices.

    Parts so much longer or shorter than the read that the gap alone costs too much are not aligned."""
    reads = reads.select("frag", F.col("seq").alias("read"), F.length("seq").cast("long").alias("size"))
    sizes = targets.select("tid", F.length("seq").cast("long").alias("whole"))
    rows = chains.join(reads, "frag").join(sizes, "tid")
    begin, end = F.greatest(F.col("start") - F.col("first"), F.lit(0)), F.least(F.col("stop") + F.col("size") - F.col("last"), "whole")
    rows = rows.withColumns({"from": begin, "to": end})
    length = F.col("to") - F.col("from")
    apart = F.abs(length - F.col("size"))
    most = F.least(length, "size") * rules.match - F.when(apart > 0, rules.gap_open + rules.gap_extend * apart).otherwise(0)
    rows = with_slices(good_scores(rows.withColumn("score", most), F.col("size"), rules).drop("score"), target_blocks(targets))
    read = F.when(F.col("fwd"), F.col("read")).otherwise(reverse_complement(F.col("read")))
    found = score_alignments(rows.select("frag", "tid", "fwd", "start", "stop", F.col("from").alias("pos"), "size", read.alias("read"), F.col("slice").alias("target")), rules=rules)
    return good_scores(found, F.col("size"), rules).drop("size")


def missing_mates(anchors: DataFrame, chains_of_mates: DataFrame, mates: DataFrame, targets: DataFrame, most_length: int) -> DataFrame:
    """(frag, tid, fwd, from, mate, window): for anchors (frag, tid, fwd, start, stop), chains of one mate, without a chain
    of the other on that target, the other one (frag, seq) and where on the target it must lie within a fragment."""
    alone = anchors.join(chains_of_mates.select("frag", "tid").distinct(), ["frag", "tid"], "left_anti")
    rows = alone.join(mates.select("frag", F.col("seq").alias("mate")), "frag").join(targets.select("tid", F.length("seq").cast("long").alias("whole")), "tid")
    begin = F.when(F.col("fwd"), F.col("start")).otherwise(F.greatest(F.col("stop") - most_length, F.lit(0)))
    end = F.when(F.col("fwd"), F.least(F.col("start") + most_length, "whole")).otherwise(F.col("stop"))
    rows = with_slices(rows.withColumns({"from": begin, "to": end}).select("frag", "tid", "fwd", "mate", "from", "to"), target_blocks(targets))
    return rows.select("frag", "tid", "fwd", "from", "mate", F.col("slice").alias("window"))


def good_scores(scored: DataFrame, read_length: Column, rules: ScoreRules = ScoreRules()) -> DataFrame:
    """Alignments with at least the rules' share of a perfect score."""
    return scored.filter(F.col("score") >= read_length * rules.match * rules.least)


def rescue(orphan_reads: DataFrame, most_edits: int, pairs_each: int = 1_000) -> DataFrame:
    """(frag, tid, edits, at) of missing mates (frag, tid, mate, window) found in the window near their partner:
    the mate's reverse complement with at most ``most_edits`` edits, anywhere in the window. Where there is a column fwd
    and it is false, the partner lies on the reverse strand, so the mate is sought as it is. With a column from, at is a
    place on the target."""
    names = orphan_reads.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.iloc[np.argsort(pdf["query"].str.len().to_numpy(), kind="stable")]
            for a in range(0, len(pdf), pairs_each):
                part = pdf.iloc[a : a + pairs_each].copy()
                part["edits"], at = infix_distances(part["query"].tolist(), part["window"].tolist())
                part["at"] = at + part["from"]
                yield part.loc[part["edits"] <= most_edits, ["frag", "tid", "edits", "at"]]

    mate = reverse_complement(F.col("mate"))
    query = F.when(F.col("fwd"), mate).otherwise(F.col("mate")) if "fwd" in names else mate
    rows = orphan_reads.select("frag", "tid", query.alias("query"), "window", (F.col("from") if "from" in names else F.lit(0)).cast("long").alias("from"))
    tid = orphan_reads.schema["tid"].dataType.simpleString()
    return rows.mapInPandas(run, f"frag long, tid {tid}, edits int, at long")


def infix_distances(queries: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each query against any part of its text, and where that part ends (exclusive); all pairs at once."""
    q, n = _padded(queries, 1)
    t, m = _padded(texts, 2)
    steps = np.arange(t.shape[1] + 1)
    row = np.zeros((len(n), len(steps)), np.int64)
    last = row.copy()
    for i in range(1, q.shape[1] + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        new[:, 1:] = np.minimum(row[:, :-1] + (t != q[:, i - 1 : i]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps  # gaps along the text
        last[n == i] = row[n == i]
    last[steps[None] > m[:, None]] = np.iinfo(np.int32).max
    at = last.argmin(1)
    return last[np.arange(len(n)), at], at


def infix_distance(query: str, text: str) -> tuple[int, int]:
    edits, at = infix_distances([query], [text])
    return int(edits[0]), int(at[0])
