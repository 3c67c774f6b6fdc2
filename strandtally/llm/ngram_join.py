"""Near-duplicate classes by an n-gram Jaccard join (operator 4).

Texts become sets of word shingles; equal sets are one class. Two sets whose
Jaccard similarity reaches the threshold must share a token among the first
few of each, under every global order of the tokens. Three orders are used.
The first puts rare tokens first: its frequencies come from a table of hashed
counts over all texts, so its size is fixed. The other two are by hash. Pairs
are candidates only if they pass all three filters; then the whole sets are
compared.

Within a token's list not all pairs are formed. First every class meets the
list's pivot, the class whose tokens are most common; links found there are
contracted into components. Only then are pairs formed within lists, and only
of classes that are still in different components. A pair left out has both its
classes in one component already, so the components are exact.

Edge cases: a null text, or one without words, has an empty set and is linked
with nothing; repeated rows are members of one class; a null identifier never
becomes a component's identifier unless the component has no other. Of tokens
equally rare the smaller hash comes first, which changes no result. An empty
table gives an empty one; only doc_id and text are read by the join, so further
columns may have any name.

Sets and texts are known by over 100 bits of hash, shingles by 64: two shingles
of one pair of texts of a thousand words are alike by chance once in 10^13 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import free_prefix, remove, stored
from .wordscan import mix, scan, slices, windows

_CHUNK = 4096  # cells of the count table in one row
_SALTS = (np.uint64(0x8F14E45FCEEA167A), np.uint64(0xC9F0F895FB98AB91))
#: A class in Spark: below 2^126, so that it fits in 38 digits.
CLASS = T.DecimalType(38, 0)
_CLASS = "decimal(38,0)"


def class_array(high: np.ndarray, low: np.ndarray, there: np.ndarray) -> pa.Array:
    """Classes from their upper and lower 64 bits; null where not ``there``."""
    both = np.empty((len(low), 2), "<u8")
    both[:, 0], both[:, 1] = low, high
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(low), [pa.py_buffer(np.packbits(there, bitorder="little").tobytes()), pa.py_buffer(both.tobytes())])


def low_bits(array: pa.Array) -> np.ndarray:
    """64 bits of each value: of a class the lower half."""
    if pa.types.is_decimal(array.type):
        return np.ascontiguousarray(np.frombuffer(array.buffers()[1], "<u8").reshape(-1, 2)[array.offset : array.offset + len(array), 0])
    return array.to_numpy().view(np.uint64)


@dataclass(frozen=True)
class JoinRules:
    """size: words in a shingle. percent: least similarity, in whole percent.
    cells: size of the table of hashed counts. extra: a set's first tokens under
    the hash orders go this much further, and that many more must be shared. filter_bits: a bit filter has two to
    this power bits; a full one lets more rows through and changes no result."""

    size: int = 3
    percent: int = 90
    cells: int = 1 << 20
    extra: int = 8
    filter_bits: int = 26


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = scan(texts, lower=True)
    h = w.hashes()
    runs, at = windows(h, w.first, size)
    n = np.diff(w.first)
    bounds = np.searchsorted(at, w.first)
    out = []
    for i, words in enumerate(n.tolist()):
        if words >= size:
            out.append(np.unique(runs[bounds[i] : bounds[i + 1]]))
        elif words:
            own = np.uint64(words)
            for x in h[w.first[i] : w.first[i + 1]]:
                own = mix(np.array([own ^ x], np.uint64) * np.uint64(0x9FB21C651E98DF25))[0]
            out.append(np.array([own], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_overlap(nx: Column, ny: Column, percent: int) -> Column:
    """Fewest tokens that two sets of these sizes share at the threshold: least o with 100 o >= percent (nx + ny - o)."""
    return F.ceil((nx + ny) * F.lit(percent) / F.lit(100 + percent))


def first_tokens(n: int, percent: int) -> int:
    """How many tokens of a set of n must be looked at so that any similar set shares one."""
    return n - -(-n * percent // 100) + 1


def cell(tokens: np.ndarray, cells: int) -> np.ndarray:
    return ((tokens >> np.uint64(20)) % np.uint64(cells)).astype(np.int64)


def token_counts(docs: DataFrame, rules: JoinRules) -> np.ndarray:
    """Hashed counts of all shingles of all texts: a table of fixed size, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(rules.cells, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                own = np.concatenate(shingle_sets(part.column("text"), rules.size))
                total += np.bincount(cell(own, rules.cells), minlength=rules.cells)
        rows = [(i // _CHUNK, total[i : i + _CHUNK].tobytes()) for i in range(0, rules.cells, _CHUNK) if total[i : i + _CHUNK].any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # at most cells / _CHUNK arrays
        for batch in batches:
            for k, c in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["chunk", "counts"])

    parts = docs.select("text").mapInArrow(run, "chunk long, counts binary").repartition("chunk").mapInArrow(add, "chunk long, counts binary")
    table = np.zeros(rules.cells, np.int64)
    for row in parts.collect():  # the table: cells * 8 bytes
        table[row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK] = np.frombuffer(row.counts, np.int64)
    return table


def _first_by(key: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    if n < len(own):
        at = np.argpartition(key, n - 1)[:n]
        key, own = key[at], own[at]
    return own[np.argsort(key)]


def class_of(own: np.ndarray, common: np.ndarray, rules: JoinRules) -> tuple[int, int, np.ndarray]:
    """The upper and lower half of a set's class, and its tokens' counts. The class has in its top 12 bits how common
    the tokens are, so that the largest class of a list is its pivot, and below them 114 bits of hashes of the set."""
    count = common[cell(own, rules.cells)]
    level = min(4094, int(4095 * float(np.log2(count.clip(1)).mean()) / np.log2(max(2, int(common.max(initial=0))))))
    low = mix(np.bitwise_xor.reduce(mix(own), keepdims=True) + np.add.reduce(own, keepdims=True))[0]
    high = mix(np.add.reduce(mix(own ^ _SALTS[0]), keepdims=True) ^ np.uint64(len(own)))[0] >> np.uint64(14)
    return level << 50 | int(high), int(low), count


def sketches(docs: DataFrame, order: "Broadcast[np.ndarray]", rules: JoinRules) -> DataFrame:
    """For each text its set's size and class; for a class's first text in a task also its first tokens.

    Tokens of the hash orders are only compared within a pair, and are known by 32 bits of their hash."""
    docs = printed(docs)
    schema = T.StructType([docs.schema["doc_id"], docs.schema["print"], docs.schema["check"], T.StructField("n", T.LongType()), T.StructField("cls", CLASS), T.StructField("by0", T.ArrayType(T.LongType())), *(T.StructField(f"by{k}", T.ArrayType(T.IntegerType())) for k in (1, 2))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, met = order.value, set()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = part.num_rows
                sizes, halves, there, firsts = np.zeros(rows, np.int64), np.zeros((2, rows), np.uint64), np.zeros(rows, bool), ([], [], [])
                for i, own in enumerate(shingle_sets(part.column("text"), rules.size)):
                    sizes[i], there[i] = len(own), len(own) > 0
                    cls = None
                    if len(own):
                        high, low, count = class_of(own, common, rules)
                        cls = high, low
                        halves[:, i] = cls
                    if cls is None or cls in met:
                        for f in firsts:
                            f.append(None)
                        continue
                    met.add(cls)
                    p = first_tokens(len(own), rules.percent)
                    rare = count.argsort(kind="stable")[:p]
                    firsts[0].append(own[rare].view(np.int64))
                    for f, salt in zip(firsts[1:], _SALTS, strict=True):
                        key = mix(own ^ salt)
                        f.append(_first_by(key, key.astype(np.uint32), p + rules.extra).view(np.int32))
                arrays = [*(part.column(c) for c in ("doc_id", "print", "check")), pa.array(sizes), class_array(*halves, there), *(pa.array(f, pa.list_(kind)) for f, kind in zip(firsts, (pa.int64(), pa.int32(), pa.int32()), strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select("doc_id", "text", "print", "check").mapInArrow(run, schema)


def printed(docs: DataFrame) -> DataFrame:
    """With two hashes of the text, 128 bits by which a text is found again."""
    return docs.withColumns({"print": F.xxhash64("text"), "check": F.xxhash64(F.lit(1), "text")})


def bit_filter(rows: DataFrame, column: str, rules: JoinRules) -> np.ndarray:
    """Bits of a column's hashes, of a fixed size: what it doesn't have needn't be shuffled for a join on that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (rules.filter_bits - 3), np.uint8)
        for batch in batches:
            at = bit(low_bits(batch.column(0)), rules)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        full = np.flatnonzero(bits.reshape(-1, _CHUNK).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([bits[i * _CHUNK : (i + 1) * _CHUNK].tobytes() for i in full], pa.binary())], names=["chunk", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # at most one array for each chunk
        for batch in batches:
            for k, c in zip(batch.column("chunk").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                sums[k] = sums.get(k, np.uint8(0)) | np.frombuffer(c, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["chunk", "bits"])

    out = np.zeros(1 << (rules.filter_bits - 3), np.uint8)
    for row in rows.select(column).mapInArrow(run, "chunk long, bits binary").repartition("chunk").mapInArrow(merge, "chunk long, bits binary").collect():
        out[row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK] = np.frombuffer(row.bits, np.uint8)
    return out


def bit(hashes: np.ndarray, rules: JoinRules) -> np.ndarray:
    return (mix(hashes) >> np.uint64(64 - rules.filter_bits)).astype(np.int64)


def has_bit(bits: np.ndarray, hashes: np.ndarray, rules: JoinRules) -> np.ndarray:
    at = bit(hashes, rules)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def first_listed(sets: DataFrame, bits: "Broadcast[np.ndarray]", rules: JoinRules) -> DataFrame:
    """(cls, n, pos, token) of the first tokens that other classes may have among theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("by0")
            size = np.diff(lists.offsets.to_numpy())
            token = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            at = np.flatnonzero(has_bit(bits.value, token.view(np.uint64), rules))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row[at])) for c in ("cls", "n")), pa.array(pos[at], pa.int64()), pa.array(token[at])], names=["cls", "n", "pos", "token"])

    return sets.select("cls", "n", "by0").mapInArrow(run, f"cls {_CLASS}, n long, pos long, token long")


def texts_of(docs: DataFrame, classes: DataFrame, sets: DataFrame, rules: JoinRules, paths: list[str]) -> DataFrame:
    """One text of each of ``classes``; documents are read again, and only texts that pass a bit filter are shuffled."""
    prints = sets.select("cls", "print", "check").join(classes, "cls", "left_semi").groupBy("cls").agg(F.min(F.struct("print", "check")).alias("x"))
    prints = stored(prints.select("cls", "x.*"), "filtered-prints", paths)
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(prints, "print", rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple] = set()
        for batch in batches:
            hashes = low_bits(batch.column("print"))
            both = list(zip(hashes.tolist(), batch.column("check").to_pylist(), strict=True))
            at = [i for i in np.flatnonzero(has_bit(bits.value, hashes, rules)).tolist() if not (both[i] in met or met.add(both[i]))]
            yield batch.take(pa.array(at, pa.int64()))

    rows = printed(docs.filter("text is not null").select("text"))
    return rows.mapInArrow(run, rows.schema).join(prints, ["print", "check"]).dropDuplicates(["print", "check", "cls"]).select("cls", "text")  # dealt by print already


def similar(pairs: DataFrame, sets: DataFrame, docs: DataFrame, rules: JoinRules) -> DataFrame:
    """The pairs (x, y) of classes whose whole sets reach the threshold; the hash orders' filters come first.

    The tables on the way are removed once the pairs are stored."""
    sc, paths = docs.sparkSession.sparkContext, []
    pairs = stored(pairs, "candidates", paths)
    members = stored(pairs.select(F.col("x").alias("cls")).union(pairs.select("y")).distinct(), "candidate-classes", paths)
    bits = sc.broadcast(bit_filter(members, "cls", rules))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has_bit(bits.value, low_bits(batch.column("cls")), rules)))

    own = sets.select("cls", "n", "by1", "by2")
    own = stored(own.mapInArrow(pick, own.schema).join(members, "cls", "left_semi").dropDuplicates(["cls"]), "candidate-sets", paths)
    for k in ("x", "y"):
        pairs = pairs.join(own.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), *(F.col(f"by{i}").alias(f"{k}{i}") for i in (1, 2))), k)
    o = least_overlap(F.col("nx"), F.col("ny"), rules.percent)
    pairs = stored(pairs.filter((F.least("nx", "ny") >= o) & shares_first(o, rules)).select("x", "y"), "filtered", paths)
    members = stored(pairs.select(F.col("x").alias("cls")).union(pairs.select("y")).distinct(), "filtered-classes", paths)
    texts = stored(texts_of(docs, members, sets, rules, paths), "filtered-texts", paths)
    for k in ("x", "y"):
        pairs = pairs.join(texts.select(F.col("cls").alias(k), F.col("text").alias(f"text_{k}")), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_x", 1 << 20):
                a, b = (shingle_sets(part.column(c), rules.size) for c in ("text_x", "text_y"))
                ok = []
                for p, q in zip(a, b, strict=True):
                    both = np.concatenate([p, q])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    ok.append(shared > 0 and 100 * shared >= rules.percent * (len(p) + len(q) - shared))
                at = pa.array(np.flatnonzero(ok))
                yield pa.RecordBatch.from_arrays([part.column("x").take(at), part.column("y").take(at)], names=["x", "y"])

    links = stored(pairs.select("x", "y", "text_x", "text_y").mapInArrow(run, f"x {_CLASS}, y {_CLASS}"), "links")
    remove(paths)
    return links


def shares_first(o: Column, rules: JoinRules) -> Column:
    """The filters of both hash orders. Of two sets that share o tokens or more, the k-th shared token comes
    after n - o others at most, so the first 1 + extra shared ones are among the first n - o + 1 + extra of each.

    A pair passes if two of its own tokens are alike in their 32 bits, as shared ones can't be counted then."""
    fine = F.lit(True)
    for i in (1, 2):
        x, y = (F.slice(f"{k}{i}", F.lit(1), (F.col(f"n{k}") - o + 1 + rules.extra).cast("int")) for k in ("x", "y"))
        enough = F.size(F.array_intersect(x, y)) >= F.least(o, F.lit(1 + rules.extra))
        fine = fine & (enough | (F.size(F.array_distinct(x)) < F.size(x)))
    return fine


def near_classes(docs: DataFrame, rules: JoinRules = JoinRules()) -> DataFrame:
    """One row for each text: doc_id, print and check (hashes of the text), n_shingles, cls (null without words), component_id, head.

    head is true for one row of each component, of those with its smallest doc_id."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    order = spark.sparkContext.broadcast(token_counts(docs, rules))
    paths: list[str] = []
    rows = stored(sketches(docs, order, rules), "shingle-sets", paths)
    sets = rows.filter("by0 is not null")  # a class has one row for each task that met it

    # tokens that several classes have among their first, with the most common class as pivot
    lists = sets.select("cls", F.explode("by0").alias("token")).groupBy("token").agg(F.min("cls").alias("low"), F.max("cls").alias("pivot"))
    lists = stored(lists.filter("low != pivot").drop("low"), "shared-tokens", paths)
    listed = stored(first_listed(sets, spark.sparkContext.broadcast(bit_filter(lists, "token", rules)), rules).join(lists, "token"), "token-lists", paths)

    # each class against the pivots of its lists; both places in the list decide whether the pair can be similar
    pivots = listed.filter("cls = pivot").select("token", F.col("n").alias("pn"), F.col("pos").alias("ppos")).distinct()
    o = least_overlap(F.col("n"), F.col("pn"), rules.percent)
    near = (F.col("pos") <= F.col("n") - o) & (F.col("ppos") <= F.col("pn") - o)
    pairs = listed.filter("cls != pivot").join(pivots, "token").filter(near).select(F.col("cls").alias("x"), F.col("pivot").alias("y")).distinct()
    links = similar(pairs, sets, docs, rules)
    roots = components(links, "x", "y")

    # then pairs of classes that share a first token and are not connected yet
    joined = listed.join(roots, listed["cls"] == roots["vertex"], "left").select("token", "cls", "n", "pos", F.coalesce("root", "cls").alias("root"))
    several = joined.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("token")
    left = stored(joined.join(several, "token", "left_semi"), "open-lists", paths)
    # similar sets differ in size by a bounded share: a list falls into bands of sizes, and only neighbouring ones meet
    band = F.floor(F.log("n") / F.lit(1.001 * float(np.log(100 / rules.percent)))).cast("int") if rules.percent < 100 else F.col("n").cast("int")
    left = left.withColumn("band", band)
    a, b = (left.select("token", "band", *(F.col(c).alias(f"{c}_{k}") for c in ("cls", "n", "pos", "root"))) for k in "ab")
    b = b.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    o = least_overlap(F.col("n_a"), F.col("n_b"), rules.percent)
    near = (F.col("n_a") >= o) & (F.col("pos_a") <= F.col("n_a") - o) & (F.col("pos_b") <= F.col("n_b") - o)
    below = (F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("cls_a") < F.col("cls_b"))
    pairs = a.join(b, ["token", "band"]).filter(below & (F.col("root_a") != F.col("root_b")) & near)
    more = similar(pairs.select(F.col("cls_a").alias("x"), F.col("cls_b").alias("y")).distinct(), sets, docs, rules)
    roots = components(links.unionByName(more), "x", "y")
    rows = stored(rows.drop("by0", "by1", "by2"), "classes-of-texts")  # all that is left to read
    remove(paths)

    classes = rows.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows"))
    classes = classes.join(roots, classes["cls"] == roots["vertex"], "left").select("cls", "id", "rows", F.coalesce("root", "cls").alias("root"))
    classes = stored(classes, "classes")
    ids = classes.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "cls")).alias("least"))
    named = stored(classes.join(ids, "root").select("cls", "rows", F.col("least.id").alias("component_id"), (F.col("cls") == F.col("least.cls")).alias("first")), "classes-named")
    # classes with over a ten thousandth of all rows, fewer than 10,000, are broadcast; rows of the others are shuffled
    whole = named.agg(F.sum("rows")).first()[0] or 0
    often = named.filter(F.col("rows") > whole / 10_000).select("cls", F.col("component_id").alias("often_id"), F.col("first").alias("often"))
    met = rows.filter("cls is not null").select("doc_id", "print", "check", "n", "cls").join(F.broadcast(often), "cls", "left")
    hot = met.filter("often is not null").select("doc_id", "print", "check", "n", "cls", F.col("often_id").alias("component_id"), F.col("often").alias("first"))
    rest = met.filter("often is null").drop("often_id", "often").join(named.filter(F.col("rows") <= whole / 10_000).drop("rows"), "cls")
    out = hot.unionByName(rest)
    out = out.select("doc_id", "print", "check", F.col("n").alias("n_shingles"), "cls", "component_id", (F.col("first") & F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("head"))
    alone = rows.filter("cls is null").select("doc_id", "print", "check", F.col("n").alias("n_shingles"), "cls", F.col("doc_id").alias("component_id"), F.lit(True).alias("head"))
    return out.unionByName(alone)


def ngram_jaccard_join(docs: DataFrame, rules: JoinRules = JoinRules()) -> DataFrame:
    """One row for each text: doc_id, n_shingles, component_id."""
    return near_classes(docs, rules).select("doc_id", "n_shingles", "component_id")


def distinct_rows(docs: DataFrame, rules: JoinRules = JoinRules()) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one row with its smallest doc_id; texts without words stay.

    Rows with words that are equal in doc_id and text are copies, of which one stays."""
    p = free_prefix(docs, "__near_")
    heads = near_classes(docs, rules).filter("head").groupBy(F.col("doc_id").alias(p + "id"), F.col("print").alias(p + "print"), F.col("check").alias(p + "check"))
    heads = stored(heads.agg(F.first("cls").alias(p + "cls"), F.count("*").alias(p + "n")), "near-heads")
    # of equal sets in different texts with one doc_id, one text stays
    one = heads.filter(F.col(p + "cls").isNotNull()).groupBy(p + "id", p + "cls").agg(F.min(F.struct(p + "print", p + "check", p + "n")).alias("x")).select(p + "id", "x.*")
    heads = stored(one.unionByName(heads.filter(F.col(p + "cls").isNull()).select(p + "id", p + "print", p + "check", F.lit(1).cast("long").alias(p + "n"))), "near-kept")
    same = lambda h: docs["doc_id"].eqNullSafe(h[p + "id"]) & F.xxhash64(docs["text"]).eqNullSafe(h[p + "print"]) & F.xxhash64(F.lit(1), docs["text"]).eqNullSafe(h[p + "check"])
    several = heads.filter(F.col(p + "n") > 1)
    if several.isEmpty():
        return docs.join(heads, same(heads), "left_semi")
    single = heads.filter(F.col(p + "n") == 1)
    return docs.join(single, same(single), "left_semi").unionByName(docs.join(several, same(several), "left_semi").dropDuplicates(["doc_id", "text"]))
