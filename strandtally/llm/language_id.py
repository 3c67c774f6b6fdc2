"""Language identification by a bidirectional gated recurrent network over bytes (operator 1).

The network is trained in numpy, by backpropagation through time, on windows of
a bounded sample of labelled texts. It labels every byte of a text: texts are
read whole, in windows of a fixed length, each from both ends, and the label
probabilities at letters are averaged over the text.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, as
are all texts if there is nothing to learn from. A null identifier counts as an
empty text when rows are dealt to training and held-out ones. Rows without a
label are not learned from but get a prediction; repeated rows are predicted
one by one and learned from once. Of equally probable labels the first in
alphabetical order is given, and of equally frequent ones the first is learned.
An empty table gives an empty one; columns other than doc_id, text and lang are
not read and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .wordscan import raw_bytes, slices

LETTER = np.zeros(256, bool)
LETTER[ord("A") : ord("Z") + 1] = LETTER[ord("a") : ord("z") + 1] = LETTER[0x80:] = True


@dataclass(frozen=True)
class NetRules:
    """hidden: units in each direction. window: bytes read at a time. texts: labelled texts of each language that are
    learned from, at most; all_texts: those of all languages together, of which each has an equal part, so more languages
    than that are an error. crops: windows taken from each text. epochs, batch, rate, seed: training."""

    hidden: int = 8
    window: int = 96
    texts: int = 500
    all_texts: int = 128_000
    crops: int = 4
    epochs: int = 5
    batch: int = 128
    rate: float = 0.012
    seed: int = 7


class Direction:
    """One gated recurrent layer; arrays are (feature, window). Gates: update, reset, candidate."""

    def __init__(self, hidden: int, rng: np.random.Generator) -> None:
        self.table = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
        self.carry = rng.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype(np.float32)

    def run(self, x: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States after each byte; x is (time, window)."""
        k = self.carry.shape[1]
        h = np.zeros((k, x.shape[1]), np.float32)
        out = np.empty((len(x), k, x.shape[1]), np.float32)
        rows = np.ascontiguousarray(self.table.T)
        for t, row in enumerate(x):
            a, g = np.ascontiguousarray(rows.take(row, axis=0).T), self.carry @ h
            gate = a[: 2 * k]
            gate += g[: 2 * k]
            gate *= 0.5
            np.tanh(gate, out=gate)
            gate += 1
            gate *= 0.5
            z, r = gate[:k], gate[k:]
            n = np.tanh(a[2 * k :] + r * g[2 * k :])
            if trace is not None:
                trace.append((h, z, r, n, g[2 * k :]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def back(self, x: np.ndarray, trace: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and carry, given those of the states."""
        k = self.carry.shape[1]
        to_table, to_carry = np.zeros_like(self.table), np.zeros_like(self.carry)
        dh = np.zeros_like(grad[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, n, g = trace[t]
            dh = dh + grad[t]
            dn = dh * (1 - z) * (1 - n * n)
            gates = np.concatenate([dh * (h - n) * z * (1 - z), dn * g * r * (1 - r), dn])
            inner = np.concatenate([gates[: 2 * k], dn * r])
            to_carry += inner @ h.T
            for f in range(3 * k):
                to_table[f] += np.bincount(x[t], gates[f], 256)
            dh = dh * z + self.carry.T @ inner
        return to_table, to_carry


class Net:
    def __init__(self, labels: list[str], rules: NetRules) -> None:
        rng = np.random.default_rng(rules.seed)
        self.labels = labels
        self.ahead, self.behind = Direction(rules.hidden, rng), Direction(rules.hidden, rng)
        self.out = rng.normal(0, 0.3, (len(labels), 2 * rules.hidden)).astype(np.float32)
        self.bias = np.zeros((len(labels), 1), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.carry, self.behind.table, self.behind.carry, self.out, self.bias]

    @staticmethod
    def softmax(logits: np.ndarray) -> np.ndarray:
        logits -= logits.max(0)
        np.exp(logits, out=logits)
        logits /= logits.sum(0)
        return logits

    def label(self, x: np.ndarray, mirrored: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """(label, time, window) probabilities. mirrored: each window's bytes from its end; turn: where byte t stands there."""
        k = self.out.shape[1] // 2
        a, b = self.ahead.run(x), self.behind.run(mirrored)
        b = np.take_along_axis(b, turn[:, None, :], 0)
        flat = lambda s: s.transpose(1, 0, 2).reshape(k, -1)
        logits = self.out[:, :k] @ flat(a) + self.out[:, k:] @ flat(b) + self.bias
        return self.softmax(logits).reshape(-1, *x.shape)

    def step(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy over all letters of full windows."""
        k, (steps, n) = self.out.shape[1] // 2, x.shape
        ta: list = []
        tb: list = []
        a = self.ahead.run(x, ta)
        b = self.behind.run(x[::-1], tb)
        both = np.concatenate([a, b[::-1]], 1).transpose(1, 0, 2).reshape(2 * k, -1)
        p = self.softmax(self.out @ both + self.bias).reshape(-1, steps, n)
        p[y, :, np.arange(n)] -= 1
        p *= (mask / max(1, mask.sum()))[None]
        d = p.reshape(len(self.labels), -1)
        back = (self.out.T @ d).reshape(2 * k, steps, n).transpose(1, 0, 2)
        return [*self.ahead.back(x, ta, back[:, :k]), *self.behind.back(x[::-1], tb, back[::-1, k:]), d @ both.T, d.sum(1, keepdims=True)]

    def train(self, x: np.ndarray, y: np.ndarray, rules: NetRules) -> None:
        rng = np.random.default_rng(rules.seed + 1)
        w = self.weights()
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        total = rules.epochs * -(-len(y) // rules.batch)
        for _ in range(rules.epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(order), rules.batch):
                own = order[at : at + rules.batch]
                xb = np.ascontiguousarray(x[own].T)
                t += 1
                rate = rules.rate * (1 - 0.9 * t / total)
                for a, g, mi, vi in zip(w, self.step(xb, y[own], LETTER[xb]), m, v, strict=True):
                    np.clip(g, -1, 1, out=g)
                    mi += 0.1 * (g - mi)
                    vi += 0.01 * (g * g - vi)
                    a -= (rate * (mi / (1 - 0.9**t)) / (np.sqrt(vi / (1 - 0.99**t)) + 1e-8)).astype(np.float32)

    def predict(self, texts: pa.Array, window: int) -> np.ndarray:
        """(text, label): mean label probabilities over the letters of each whole text."""
        data, offsets = raw_bytes(texts)
        size = np.diff(offsets)
        count = -(-size // window)
        doc = np.repeat(np.arange(len(size)), count)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        begin = offsets[doc] + within * window
        length = np.minimum(begin + window, offsets[doc + 1]) - begin
        sums = np.zeros((len(size), len(self.labels)))
        weight = np.zeros(len(size))
        together = max(16, 32_000 // max(8, len(self.labels)))  # windows; each has a number for every letter and label
        for part in np.array_split(np.arange(len(doc)), max(1, len(doc) // together)):
            if not len(part):
                continue
            t = np.arange(window)[:, None]
            n = length[part]
            inside = t < n
            x = np.where(inside, data[np.minimum(begin[part] + t, len(data) - 1)], 32).astype(np.uint8)
            turn = np.where(inside, n - 1 - t, t)
            p = self.label(x, np.take_along_axis(x, turn, 0), turn)
            mask = inside & LETTER[x]
            weight += np.bincount(doc[part], mask.sum(0), len(size))
            for c in range(len(self.labels)):
                sums[:, c] += np.bincount(doc[part], (p[c] * mask).sum(0), len(size))
        return sums / np.maximum(weight, 1)[:, None]


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def train(docs: DataFrame, learn: Column, rules: NetRules = NetRules()) -> Net | None:
    """A network for the labels of the rows of ``docs`` that satisfy ``learn``; None if there are none.

    All labels are learned. Of each, the rows with the least hash of identifier and text are taken, as many as the rules
    give it (rows equal in both count once), and ``crops`` windows of each go to the driver."""
    docs = docs.filter(learn & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "text", "lang")
    counts = docs.groupBy("lang").agg(F.count("*").alias("n"))
    labels = sorted(r.lang for r in counts.select("lang").limit(rules.all_texts + 1).collect())
    if not labels:
        return None
    if len(labels) > rules.all_texts:
        raise ValueError(f"more than {rules.all_texts} languages")
    texts = min(rules.texts, rules.all_texts // len(labels))
    # by hash, some more rows than needed, so that few are sorted; the window has the exact number
    drawn = F.xxhash64("doc_id", "text")
    shares = F.broadcast(counts.select("lang", F.least(F.lit(1.0), F.lit(3.0 * texts) / F.col("n")).alias("share")))  # a row for each language
    some = docs.withColumn("order", drawn).join(shares, "lang").filter(F.shiftrightunsigned("order", 1) < F.col("share") * float(2**63)).drop("share")
    some = some.dropDuplicates(["lang", "order"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).filter(F.col("rank") <= texts)
    room = F.greatest(F.length("text") - rules.window, F.lit(1))
    crops = F.array(*(F.substring(F.col("text"), (1 + F.pmod(F.xxhash64("order", F.lit(i)), room)).cast("int"), F.lit(rules.window)) for i in range(rules.crops)))
    rows = some.select("lang", crops.alias("crops"), "order").collect()  # all_texts rows at most
    rows.sort(key=lambda r: (r.order, r.lang))
    number = {lang: i for i, lang in enumerate(labels)}
    x = [np.frombuffer(c.encode()[: rules.window].ljust(rules.window), np.uint8) for r in rows for c in r.crops]
    y = np.array([number[r.lang] for r in rows for _ in r.crops], np.int64)
    net = Net(labels, rules)
    if len(y):
        net.train(np.array(x), y, rules)
    return net


def predict(docs: DataFrame, net: Net | None, rules: NetRules = NetRules()) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", "text", letter.alias("letter"))
    if net is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    model = docs.sparkSession.sparkContext.broadcast(net)  # some kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                p = own.predict(part.column("text"), rules.window)
                letters = part.column("letter").to_numpy(zero_copy_only=False)
                best = p.argmax(1)
                names = [own.labels[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                score = np.where(letters, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def language_id(docs: DataFrame, rules: NetRules = NetRules(), folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the labelled rows that are not held out."""
    net = train(docs, fold(F.col("doc_id")) % folds != 0, rules)
    out = predict(docs, net, rules)
    return out.select("doc_id", (fold(F.col("doc_id")) % folds == 0).alias("held_out"), "lang_pred", "score")
