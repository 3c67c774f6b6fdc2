"""Ranked lexical search, score at a time over impact-ordered postings (operator 11).

What a posting adds to a score depends on its text alone, so it is a whole
number that is known beforehand: its impact. Postings of the items' terms are
stored in descending order of exact impact, over files by ranges. How many
postings each (term, impact) has is a small table beside them.

All items are worked on together, in rounds. In each, an item takes the postings
of its terms from the highest impact down to a level, chosen from that table so
that each round takes some times as many as the one before. Sums by (item,
document) are lower bounds. A term that a document has not met yet can add the
highest impact below the level at most, which gives the upper bounds of met
documents and of those not met at all. An item is done when its k-th lower bound
is above what any document not met can reach, and no more documents can still be
among the best than it has taken postings, so completing costs no more than what
came before; then the scores of these documents are completed and ranked.
Long lists of frequent terms, whose impacts are low, are so never summed over
all documents. Items that no bound settles end with all of their postings.

Edge cases: a null text has no terms, a document without terms takes no part, an
item without terms has no results. Rows of one item_id are one item with all
their terms; a null item_id is an item of its own. Repeated rows are documents of
their own, so an identifier may be found twice; equal scores go by doc_id, null
last. An empty table gives an empty one. Texts of any length are read whole, in
parts. Of the documents only doc_id and text are read, of the items item_id and
text, so further columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import remove, stored
from .wordscan import slices


@dataclass(frozen=True)
class SearchRules:
    best: int = 10
    #: Postings of an item in the first round, and how many times more in each next one.
    first: int = 2_000
    growth: int = 4
    #: Distinct terms of all items up to which they are broadcast (some 100 bytes each) and looked up while texts are
    #: read; of more terms, all of a text's terms are shuffled.
    broadcast_terms: int = 500_000
    #: Rows of items' terms up to which the plan of a round is broadcast (some 40 bytes each).
    broadcast_plan: int = 500_000
    postings_per_task: int = 2_000_000


#: Bytes of a term keep their place, A-Z in lower case; all others become spaces. Bytes from 0x80 on are letters.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_PART = 4 << 20


def term_parts(text: str) -> Iterator[list[bytes]]:
    """Terms of a text, of some million letters at once."""
    raw = text.encode().translate(_TERM_BYTES)
    at = 0
    while len(raw) - at > _PART:
        cut = raw.find(b" ", at + _PART)
        if cut < 0:
            break
        yield raw[at:cut].split()
        at = cut
    yield raw[at:].split()


def item_terms(items: DataFrame) -> DataFrame:
    """(qid, item_id, term): distinct terms of each item_id."""
    items = items.select("item_id", "text")
    schema = T.StructType([items.schema["item_id"], T.StructField("term", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, term = [], []
                for i, text in enumerate(pc.fill_null(part.column("text"), "").to_pylist()):
                    own = {t for p in term_parts(text) for t in p}
                    row += [i] * len(own)
                    term += own
                yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(row, pa.int64())), pa.array(term, pa.binary()).cast(pa.string())], names=schema.names)

    rows = items.mapInArrow(run, schema).distinct()
    ids = stored(rows.select("item_id").distinct().withColumn("qid", F.monotonically_increasing_id()), "search-items")
    return rows.join(ids, rows["item_id"].eqNullSafe(ids["item_id"])).select("qid", ids["item_id"], "term")


def term_counts(docs: DataFrame, wanted: Broadcast | None) -> DataFrame:
    """(mark, doc_id, n, term, tf): terms of every text that are wanted (all, if None), n being its terms in all.

    A row without term for each batch has the number of its documents with terms in tf and of all their terms in n."""
    docs = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("mark"))
    schema = T.StructType([T.StructField("mark", T.LongType()), docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if wanted is None else wanted.value
        for batch in batches:
            for part in slices(batch, "text"):
                row, size, term, tf, whole, having = [], [], [], [], 0, 0
                for i, text in enumerate(pc.fill_null(part.column("text"), "").to_pylist()):
                    n, own = 0, Counter()
                    for terms in term_parts(text):
                        n += len(terms)
                        own.update(terms if keep is None else filter(keep.__contains__, terms))
                    whole, having = whole + n, having + (n > 0)
                    row += [i] * len(own)
                    size += [n] * len(own)
                    term += own.keys()
                    tf += own.values()
                at = pa.array([*row, None], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("mark").take(at), part.column("doc_id").take(at), pa.array([*size, whole], pa.int64()), pa.array([*term, None], pa.binary()).cast(pa.string()), pa.array([*tf, having], pa.int64())],
                    names=schema.names,
                )

    return docs.mapInArrow(run, schema)


def postings(docs: DataFrame, terms: DataFrame, rules: SearchRules, paths: list[str]) -> DataFrame:
    """(term, impact, mark, doc_id) of the items' terms (qid, term) in all documents, by descending impact.

    Postings that add nothing are left out."""
    spark = docs.sparkSession
    distinct = terms.select("term").distinct()
    wanted = None
    if distinct.count() <= rules.broadcast_terms:
        wanted = spark.sparkContext.broadcast(frozenset(r.term.encode() for r in distinct.toLocalIterator()))
    rows = stored(term_counts(docs, wanted), "search-terms", paths)
    whole = rows.filter("term is null").agg(F.coalesce(F.sum("tf"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    n_docs, n_terms, longest = whole
    rows = rows.filter("term is not null")
    if wanted is None:
        rows = rows.join(distinct, "term", "left_semi")
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weights = rows.groupBy("term").agg(F.count("*").alias("df")).select("term", weight.cast("long").alias("w"))
    weights = stored(weights.filter("w > 0"), "search-weights", paths)
    joined = rows.join(F.broadcast(weights) if wanted is not None else weights, "term")
    if 90 * longest * n_docs < 1 << 63:
        share = F.expr(f"(90L * n * {n_docs}L) div {max(1, n_terms)}L")
    else:
        share = F.expr(f"cast(floor(cast(90L * n as decimal(19, 0)) * cast({n_docs}L as decimal(19, 0)) / {max(1, n_terms)}L) as long)")
    impact = F.col("w") * F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)")
    made = joined.withColumn("m", 100 - 90 + share).select("term", impact.alias("impact"), "mark", "doc_id").filter("impact > 0")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rules.postings_per_task))
    dealt = made.repartitionByRange(tasks, F.col("impact").desc(), "term", "mark").sortWithinPartitions(F.col("impact").desc(), "term", "mark")
    return stored(dealt, "search-postings", paths)


def levels(terms: DataFrame, lists: DataFrame, rules: SearchRules, paths: list[str]) -> DataFrame:
    """(qid, term, impact, n, before): the (term, impact) lists of each item, with the item's postings above that impact.

    The running sum is over an item's lists, which are fewer than its terms times the distinct impacts."""
    rows = terms.select("qid", "term").join(lists, "term")
    by_impact = rows.groupBy("qid", "impact").agg(F.sum("n").alias("n"))
    above = Window.partitionBy("qid").orderBy(F.col("impact").desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = by_impact.select("qid", "impact", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"))
    return stored(rows.join(above, ["qid", "impact"]).select("qid", "term", "impact", "before"), "search-levels", paths)


def plan_of(steps: DataFrame, budget: int) -> DataFrame:
    """(qid, term, level, rest): down to which impact an item goes, and what a term can still add below it.

    An item goes down to the first level at which it has ``budget`` postings, which it takes whole."""
    level = steps.filter(F.col("before") < budget).groupBy("qid").agg(F.min("impact").alias("level"))
    rest = F.coalesce(F.max(F.when(F.col("impact") < F.col("level"), F.col("impact"))), F.lit(0))
    return steps.join(level, "qid").groupBy("qid", "term", "level").agg(rest.alias("rest"))


def ranked(scores: DataFrame, best: int) -> DataFrame:
    """The best documents of each item; tasks keep their own best before anything is shuffled."""
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "mark")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def search(docs: DataFrame, items: DataFrame, rules: SearchRules = SearchRules()) -> DataFrame:
    """item_id, rank, doc_id and score of the best documents of each item."""
    paths: list[str] = []
    terms = stored(item_terms(items), "search-item-terms", paths)
    posted = postings(docs, terms, rules, paths)
    lists = stored(posted.groupBy("term", "impact").agg(F.count("*").alias("n")), "search-lists", paths)
    steps = levels(terms, lists, rules, paths)
    small = terms.count() <= rules.broadcast_plan
    near = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    budget, found = rules.first, None
    while True:
        plan = stored(plan_of(steps, budget), "search-plan", paths)
        down_to = plan.agg(F.min("level")).first()[0]
        if down_to is None:  # no item is left
            break
        met = posted.filter(F.col("impact") >= down_to).join(near(plan), "term").filter(F.col("impact") >= F.col("level"))
        met = met.groupBy("qid", "mark").agg(F.first("doc_id").alias("doc_id"), F.sum("impact").alias("score"), F.sum(F.col("impact") - F.col("rest")).alias("ahead"))
        met = stored(met, "search-met", paths)
        kth = ranked(met, rules.best).groupBy("qid").agg(F.count("*").alias("k"), F.min("score").alias("kth"))
        state = plan.groupBy("qid").agg(F.sum("rest").alias("rest"), F.max("level").alias("level")).join(kth, "qid")
        bound = F.when(F.col("k") >= rules.best, F.col("kth")).otherwise(0)
        state = state.select("qid", "rest", bound.alias("kth")).filter((F.col("rest") == 0) | (F.col("rest") < F.col("kth")))
        state = stored(state, "search-state", paths)  # items whose bounds prove that no other document is among the best
        reach = met.join(near(state), "qid").filter(F.col("ahead") + F.col("rest") >= F.col("kth"))
        open_ = reach.groupBy("qid", "rest").agg(F.count("*").alias("n")).filter((F.col("n") <= budget) | (F.col("rest") == 0))
        done = stored(state.join(open_.select("qid"), "qid", "left_semi"), "search-done", paths)
        hopeful = stored(reach.join(near(done.select("qid")), "qid", "left_semi").select("qid", "mark", "doc_id", "score"), "search-hopeful", paths)
        below = plan.filter("rest > 0").join(done.select("qid"), "qid", "left_semi").select("qid", "term", "level")
        need = hopeful.select("qid", "mark").join(near(below), "qid")
        more = posted.join(hopeful.select("mark").distinct(), "mark", "left_semi").select("mark", "term", "impact").join(need, ["mark", "term"])
        more = more.filter(F.col("impact") < F.col("level")).groupBy("qid", "mark").agg(F.sum("impact").alias("more"))
        whole = hopeful.join(more, ["qid", "mark"], "left").select("qid", "mark", "doc_id", (F.col("score") + F.coalesce("more", F.lit(0))).alias("score"))
        best = stored(ranked(whole, rules.best), "search-best")
        found = best if found is None else found.unionByName(best)
        steps = steps.join(near(done.select("qid")), "qid", "left_anti")
        budget *= rules.growth
    names = stored(terms.select("qid", "item_id").distinct(), "search-names")
    remove(paths)
    if found is None:
        found = names.select("qid", F.lit(0).alias("rank"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return found.join(names, "qid").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
