"""What each filter removes in every order of the filters (operator 13).

Each text gets a number with one bit for each filter that it fails. The rows of
these numbers, one for each document, are crossed with the broadcast orders of
the filters (120 for five), and each of the pairs gives a row for every step.
The step at which the document goes is that of the first filter it fails; counts
are conditional sums, combined in each task before the shuffle, so the shuffle
carries a row for each part, order and step and task, however many documents a
part has.

Copies are known by SHA-256. The smallest identifier of each text comes from an
aggregation; texts that hold more than a thousandth of all rows (fewer than a
thousand of them) are broadcast, other repeated ones are joined by digest.

Edge cases: a null text is empty, a null source the part ''; texts of any length
are judged whole. Of repeated rows with one identifier none is the other's copy;
a null identifier is no copy of anything and has no label, and others are no
copies of it. Of several labels for an identifier the highest values count. An
empty table gives an empty one. Only doc_id, text and source are read, and of
the labels doc_id, quality and toxic, so further columns may have any name.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

LETTERS = "ABCDE"
WORD_GAP = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows that one task crosses with all orders.
ROWS_PER_TASK = 16_384


def failures(text: Column) -> dict[str, Column]:
    """Conditions under which a text (not null) fails the filters that look at it alone."""
    words = F.array_remove(F.split(text, WORD_GAP), "")
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def copies(rows: DataFrame) -> DataFrame:
    """``rows`` (a stored table with doc_id and digest) with ``copy``: whether a smaller identifier has the same digest."""
    repeated = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "audit-repeated")
    hot = repeated.filter(F.col("n") * 1000 > rows.count()).select("digest", "first")  # fewer than a thousand rows
    others = repeated.join(F.broadcast(hot), "digest", "left_anti").select("digest", "first")
    cold = rows.join(F.broadcast(hot), "digest", "left_anti").join(others, "digest", "left")
    both = rows.join(F.broadcast(hot), "digest").unionByName(cold)
    return both.withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first")


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of every document: the filters it fails as bits, A the lowest, and its labels."""
    d = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    mask = sum((F.when(fails, bit(letter)).otherwise(0) for letter, fails in failures(F.col("text")).items()), F.lit(0))
    rows = stored(d.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "audit-flags")
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = copies(rows).withColumns({"named": F.col("doc_id").isNotNull(), "key": F.coalesce("doc_id", F.xxhash64("digest"))})  # null identifiers lie apart
    both = marked.join(known.select(F.lit(True).alias("named"), F.col("doc_id").alias("key"), "good", "toxic"), ["named", "key"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return both.select("part", (F.col("mask") + F.when(F.col("copy"), bit("E")).otherwise(0)).alias("mask"), yes("good"), yes("toxic"))


def replay(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, filter_order and step of ``rows`` (part, mask, good, toxic): counts of documents.

    kept after the step, removed at it, redundant (fails the filter, went before), unique_fails (fails this filter only),
    good_lost and toxic_lost (removed here), shapley: what the step's filter removes, summed over all orders."""
    spark = rows.sparkSession
    orders = [("".join(letters[i] for i in o), [1 << i for i in o]) for o in permutations(range(len(letters)))]
    table = spark.createDataFrame(list(enumerate(b for _, b in orders)), "number int, bits array<int>")
    first = F.lit(len(letters) + 1)
    for i in reversed(range(len(letters))):
        first = F.when(F.col("mask").bitwiseAND(F.col("bits")[i]) != 0, i + 1).otherwise(first)
    crossed = rows.crossJoin(F.broadcast(table))  # 120 orders
    steps = crossed.select("part", "mask", "good", "toxic", "number", first.alias("first"), F.posexplode("bits").alias("at", "bit"))
    fails, step = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("at") + 1
    here = F.col("first") == step
    n = lambda condition: F.sum(condition.cast("long"))
    counted = steps.groupBy("part", "number", step.alias("step")).agg(
        n(F.col("first") > step).alias("kept"), n(here).alias("removed"), n(fails & (F.col("first") < step)).alias("redundant"),
        n(F.col("mask") == F.col("bit")).alias("unique_fails"), n(here & F.col("good")).alias("good_lost"), n(here & F.col("toxic")).alias("toxic_lost"),
    )
    names = spark.createDataFrame([(i, o, s + 1, c) for i, (o, _) in enumerate(orders) for s, c in enumerate(o)], "number int, filter_order string, step int, letter string")
    counted = stored(counted.join(F.broadcast(names), ["number", "step"]), "audit-counts")
    whole = counted.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    out = counted.join(whole, ["part", "letter"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The replay of the five filters over all documents, by source."""
    rows = stored(flags(docs, labels), "audit-rows")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_TASK))
    return replay(rows.repartition(tasks))
