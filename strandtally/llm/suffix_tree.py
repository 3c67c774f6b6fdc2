"""Language-model scoring with a probabilistic suffix tree (operator 8).

The tree is over the bytes of lower-cased texts. Spark counts all runs of
``depth`` bytes and the byte that follows, over all training texts, and adds
them up for shorter contexts. A context is a state if it occurs a few times and
its next-symbol distribution diverges from that of the context one byte
shorter; states grow with the texts. Distributions are smoothed with those of
the next shorter state. The tree is a Spark table: texts are dealt into chunks,
each chunk's distinct contexts are joined to their probabilities, always from
the longest state that is a suffix, and tasks score a chunk's whole texts.

Beside it stands a unigram baseline over words: all words of all training texts
are counted. The most frequent ones, a table of fixed size, are looked up in
tasks; all others are joined to their counts.

Edge cases: a null text counts as empty and has one token, its end; repeated
rows are scored one by one; without training texts both models are uniform. A
null identifier counts as an empty text when rows are dealt. Of words equal in
count at the edge of the table of frequent ones, the lower hashes are in it,
which changes no score. An empty table gives an empty one; only doc_id and text
are read, so further columns may have any name.

Words are known by 64 bits of their hashes: among a billion distinct words some
0.03 pairs are expected to be taken for one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .language_id import fold
from .shared import batches_of, give_back, remove, stored
from .wordscan import LOWER, raw_bytes, scan, slices

START, END = 0xFE, 0xFF  # bytes that UTF-8 never has
END_TOKEN = 0x0E11D0F7E7700001


@dataclass(frozen=True)
class TreeRules:
    """depth: longest context. least_count: training symbols that must follow a context that is a state, whatever the
    input's size. least_share: a least share of all training symbols besides, if any. divergence, gain: least Kullback-Leibler divergence from the
    shorter context, for each symbol and over all. weight: pseudo-count of the shorter state's distribution.
    common: words whose counts every task has. chunk: bytes of text that are scored together."""

    depth: int = 6
    least_count: int = 2
    least_share: float = 0.0
    divergence: float = 0.005
    gain: float = 10.0
    weight: float = 3.0
    common: int = 100_000
    chunk: int = 64 << 20


class Tally:
    """How often 64-bit keys occur, each time with weight 0 or 1. Keys are sorted some at a time; sums are kept sorted, and
    given out when there are more than four fifths of ``most`` distinct keys. A chunk's sums are below its bytes."""

    def __init__(self, most: int = 5 << 20, at_once: int = 1 << 21) -> None:
        self.most, self.at_once = most, at_once
        self.keys, self.counts, self.held = [], [], 0
        self.fresh: tuple[list[np.ndarray], ...] = ([], [])
        self.waiting = 0

    def add(self, keys: np.ndarray, weight: int) -> None:
        self.fresh[weight].append(keys)
        self.waiting += len(keys)
        if self.waiting > self.at_once:
            self.settle()
            if self.held > self.most:
                self.merge()

    def settle(self) -> None:
        for weight, fresh in enumerate(self.fresh):
            if fresh:
                keys = np.concatenate(fresh)
                fresh.clear()
                keys.sort()  # without an order beside it, which would take several times as long
                at = firsts(keys)
                self.keys.append(keys[at])
                self.counts.append((np.diff(np.append(at, len(keys))) * weight).astype(np.int32))
                self.held += len(at)
        self.waiting = 0

    def merge(self) -> None:
        if len(self.keys) > 1:
            # a range of keys after the other, so that no second copy and no order of all of them is made
            edges = max(self.keys, key=len)[1 << 17 :: 1 << 17]
            cuts = [np.concatenate([[0], np.searchsorted(k, edges), [len(k)]]) for k in self.keys]
            parts = []
            for r in range(len(edges) + 1):
                parts.append(summed(*(np.concatenate([x[c[r] : c[r + 1]] for x, c in zip(xs, cuts, strict=True)]) for xs in (self.keys, self.counts))))
            self.keys, self.counts = [], []
            self.keys, self.counts = ([np.concatenate(x)] for x in zip(*parts, strict=True))
            self.held = len(self.keys[0])

    def full(self) -> bool:
        return self.held > self.most // 5 * 4 and len(self.keys) == 1

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        self.merge()
        got = (self.keys[0], self.counts[0]) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        self.keys, self.counts, self.held = [], [], 0
        return got


def firsts(keys: np.ndarray) -> np.ndarray:
    """Where each distinct key of sorted ones begins."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's weights; quickest if the keys are a few sorted runs."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    del order
    at = firsts(keys)
    return keys[at], np.add.reduceat(weights, at, dtype=weights.dtype) if len(at) else weights


def streams(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each as ``depth`` start symbols, its bytes and an end; where each begins."""
    data, offsets = raw_bytes(texts)
    n = len(offsets) - 1
    begin = offsets + np.arange(n + 1) * (depth + 1)
    out = np.full(begin[-1], START, np.uint8)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    out[np.arange(len(data)) + (doc + 1) * depth + doc] = LOWER[data]
    out[begin[1:] - 1] = END
    return out, begin


def grams(stream: np.ndarray, depth: int) -> np.ndarray:
    """Each symbol that is not a start, with the ``depth`` symbols before it, as one key."""
    padded = np.concatenate([np.zeros(8 - depth - 1, np.uint8), stream])
    key = np.ndarray(max(0, len(stream) - depth), ">u8", padded, strides=(1,)).astype(np.uint64)  # eight bytes from each place on
    key &= np.uint64((1 << (8 * (depth + 1))) - 1)
    return key[stream[depth:] != START]


def count(texts: DataFrame, rules: TreeRules) -> DataFrame:
    """(word, chunk, key, n) of texts (chunk, held_out, text): counts of words (word true) over training texts, and the
    contexts with their next symbol that any text of a chunk has, with their counts over its training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, runs, now = Tally(5 << 18, 1 << 20), Tally(), 0

        def give(tally: Tally, word: bool) -> Iterator[pa.RecordBatch]:
            all_keys, all_n = tally.take()
            for at in range(0, len(all_keys), 1 << 16):  # the executor holds a batch outside its heap
                keys, n = all_keys[at : at + (1 << 16)], all_n[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), word)), pa.array(np.full(len(keys), now, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "chunk", "key", "n"])

        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            for c in np.unique(chunks):
                if c != now:
                    yield from give(runs, False)
                    now = int(c)
                rows = batch.filter(pa.array(chunks == c))
                held_out = rows.column("held_out").to_numpy(zero_copy_only=False)
                for learn in (True, False):
                    for part in slices(rows.filter(pa.array(held_out != learn)), "text", 1 << 20):
                        text = part.column("text")
                        if learn:
                            words.add(np.append(scan(text, lower=True).hashes(), np.full(len(text), END_TOKEN, np.uint64)), 1)
                        runs.add(grams(streams(text, rules.depth)[0], rules.depth), int(learn))
                        for tally, word in ((words, True), (runs, False)):
                            if tally.full():
                                yield from give(tally, word)
        yield from give(words, True)
        yield from give(runs, False)
        del words, runs
        give_back()

    return texts.select("chunk", "held_out", "text").mapInArrow(run, "word boolean, chunk int, key long, n long")


def tree(counts: DataFrame, rules: TreeRules, paths: list[str] | None = None) -> DataFrame:
    """(key, log10): log10 probability of every context's next symbol in a table of counts (key, n), from the longest
    state that is a suffix of the context.

    From the empty context on, each length's table is joined to the one before; no part of it leaves Spark. The tables
    that the result is made from are added to ``paths``."""
    shorter = lambda d: F.expr(f"key & {(1 << (8 * (d + 1))) - 1}L")
    levels = [counts]
    for d in range(rules.depth - 1, -1, -1):
        levels.append(stored(levels[-1].groupBy(shorter(d).alias("key")).agg(F.sum("n").alias("n")), "tree-counts", paths))
    levels.reverse()
    whole = levels[0].agg(F.sum("n")).first()[0] or 0
    least = max(rules.least_count, whole * rules.least_share)
    smooth = lambda n, total, base: (n + rules.weight * base) / (total + rules.weight)
    first = smooth(F.col("n"), F.lit(float(whole)), F.lit(1 / 256)) if whole else F.lit(1 / 256)
    share = (F.col("n") / F.lit(float(whole or 1))).cast("float")
    known = levels[0].select("key", share.alias("share"), first.cast("float").alias("p"))
    alike = Window.partitionBy("ctx")
    for d in range(1, rules.depth + 1):
        up = known.select(F.col("key").alias("up"), F.col("share").alias("up_share"), F.col("p").alias("base"))
        rows = levels[d].select("key", "n", shorter(d - 1).alias("up")).join(up, "up")
        # n ln(n / total) - n ln(share in the shorter context), summed; the total comes in when it is known
        part = F.when(F.col("n") > 0, F.col("n") * (F.log("n") - F.log("up_share"))).otherwise(0.0)
        rows = rows.select("key", "n", "base", F.shiftright("key", 8).alias("ctx"), part.alias("part"))
        rows = rows.withColumn("total", F.sum("n").over(alike)).withColumn("part", F.sum("part").over(alike))
        gain = F.when(F.col("total") > 0, F.col("part") - F.col("total") * F.log("total"))
        state = F.coalesce((F.col("total") >= least) & (gain >= rules.gain) & (gain >= F.col("total") * rules.divergence), F.lit(False))
        p = F.when(state, smooth(F.col("n"), F.col("total"), F.col("base"))).otherwise(F.col("base"))
        known = rows.select("key", F.coalesce(F.col("n") / F.nullif("total", F.lit(0)), F.lit(0.0)).cast("float").alias("share"), p.cast("float").alias("p"))
        if d < rules.depth:
            known = stored(known, "tree-states", paths)
    return known.select("key", F.log10("p").cast("float").alias("log10"))


def lm_scores(docs: DataFrame, rules: TreeRules = TreeRules(), folds: int = 5, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text."""
    spark = docs.sparkSession
    out_of = F.coalesce(fold(F.col("doc_id")) % folds == held_out, F.lit(False))
    chunks = max(2, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // rules.chunk))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", out_of.alias("held_out"), "text")
    texts = stored(rows.repartition(chunks).withColumn("chunk", F.spark_partition_id()), "lm-texts")
    paths: list[str] = []
    with batches_of(spark, 1_000):
        counts = stored(count(texts, rules), "lm-counts", paths)
    words = stored(counts.filter("word").groupBy(F.col("key").alias("token")).agg(F.sum("n").alias("c")), "lm-words")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    keys_of = counts.filter("NOT word")
    logs_of = tree(stored(keys_of.groupBy("key").agg(F.sum("n").alias("n")), "tree-counts", paths), rules, paths)
    looked_up = stored(keys_of.select("chunk", "key").join(logs_of, "key"), "lm-looked-up")  # one row for each context of a chunk
    remove(paths)
    top = words.orderBy(F.col("c").desc(), "token").limit(rules.common).toArrow()  # a table of fixed size
    key, c = top.column("token").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(key)
    size = n + 0.5 * (v + 1)
    common = spark.sparkContext.broadcast((np.append(key[order], np.uint64(2**64 - 1)), np.append(np.log10((c[order] + 0.5) / size), 0.0), len(key)))

    own = [T.StructField("row", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType())]
    numbers = [T.StructField(c, t) for c, t in (("n_tokens", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType()), ("rare", T.ArrayType(T.LongType())))]

    spare = 64 - 8 * (rules.depth + 1)  # bits of a key that its context and symbol leave; a text's number within its slice is there

    def scores(part: pa.RecordBatch, grams_: np.ndarray, log10: np.ndarray) -> pa.RecordBatch:
        keys, logs, known = common.value
        text = part.column("text")
        w = scan(text, lower=True)
        token = np.append(w.hashes(), np.full(len(text), END_TOKEN, np.uint64))
        doc = np.append(w.doc, np.arange(len(text)))
        place = np.searchsorted(keys, token)
        hit = (keys[place] == token) & (place < known)
        rest = np.flatnonzero(~hit)
        rest = rest[np.argsort(doc[rest], kind="stable")]
        ends = np.searchsorted(doc[rest], np.arange(len(text) + 1)).astype(np.int32)
        stream, begin = streams(text, rules.depth)
        run_ = grams(stream, rules.depth) << np.uint64(spare) | np.repeat(np.arange(len(text), dtype=np.uint64), np.diff(begin) - rules.depth)
        run_.sort()
        of = run_ & np.uint64((1 << spare) - 1)
        run_ >>= np.uint64(spare)
        at = firsts(run_)
        found = log10[np.searchsorted(grams_, run_[at].view(np.int64))]
        score = np.bincount(of.view(np.int64), np.repeat(found, np.diff(np.append(at, len(run_)))), len(text))
        arrays = [
            part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(np.diff(w.first) + 1, pa.int64()), pa.array(np.bincount(doc[hit], minlength=len(text)), pa.int64()),
            pa.array(np.bincount(doc[hit], logs[place[hit]], len(text)).astype(float)), pa.array(score.astype(float)), pa.ListArray.from_arrays(pa.array(ends), pa.array(token[rest].view(np.int64))),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in (*own, *numbers)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by chunk, its contexts before its texts: only the contexts of one chunk are held."""
        none = lambda: [np.empty(1 << 16, np.int64), np.empty(1 << 16, np.float32)]
        held, n, ready = none(), 0, False
        for batch in batches:
            place = batch.column("place").to_numpy()
            for at in np.unique(place):
                rows = batch.filter(pa.array(place == at))
                if at % 2 == 0:
                    if ready:
                        held, n, ready = none(), 0, False
                    while n + len(rows) > len(held[0]):
                        for x in held:
                            x.resize(len(x) * 2, refcheck=False)
                    for x, name in zip(held, ("key", "log10"), strict=True):
                        x[n : n + len(rows)] = rows.column(name).to_numpy()
                    n += len(rows)
                    continue
                if not ready:
                    by_key = np.argsort(held[0][:n])
                    for k in (0, 1):
                        held[k] = held[k][by_key]
                    del by_key
                    ready = True
                    give_back()
                for part in slices(rows, "text", 1 << 19):
                    for first in range(0, len(part), 1 << spare):
                        yield scores(part.slice(first, 1 << spare), *held)
        del held
        give_back()

    place = lambda kind: (F.col("chunk") * 2 + kind).alias("place")
    contexts = looked_up.select(place(0), "key", "log10", *(F.lit(None).cast(f.dataType).alias(f.name) for f in own), F.lit(None).cast("string").alias("text"))
    both = contexts.unionByName(texts.select(place(1), F.lit(None).cast("long").alias("key"), F.lit(None).cast("float").alias("log10"), *(f.name for f in own), "text"))
    by_chunk = both.repartition(chunks, F.floor(F.col("place") / 2)).sortWithinPartitions("place")
    with batches_of(spark, 2_000):
        rows = stored(by_chunk.mapInArrow(run, T.StructType([*own, *numbers])), "lm-scores")
    rare = rows.select("row", F.explode("rare").alias("token")).join(words, "token")
    rare = rare.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10((F.col("c") + 0.5) / F.lit(size))).alias("sum"))
    known = F.col("known") + F.coalesce("more", F.lit(0))
    out = rows.drop("rare").join(rare, "row", "left")
    unknown = F.lit(float(np.log10(0.5 / size)))
    return out.select(
        "doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("sum", F.lit(0.0)) + (F.col("n_tokens") - known) * unknown).alias("base_score"), "score",
    )
