"""Exact deduplication by content sort (operator 2).

Rows are range-partitioned between sampled splitters and sorted within each
partition by Spark's external sort, so that equal texts stand next to each
other; each row is then compared in full with its neighbour. The sort key
begins with the text's first bytes and a hash, which keeps the splitter sample
small, then the whole text, then the identifier. As the identifier is part of
the partitioning key, a text that a third of all rows share is spread over many
partitions; runs that cross a partition's edge are joined afterwards by their
SHA-256, two rows at most for each partition.

Edge cases: a null text counts as empty; rows equal in text and identifier form
one group, of which one row stays; a null identifier sorts below all others and
stays only if there is no other. Which of the rows equal in both stays is
open. An empty table gives an empty one; columns of the input may have any name.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_prefix, partitions_for, stored

P = "__sort_"


def marks(p: str) -> T.StructType:
    return T.StructType([T.StructField(p + "part", T.LongType()), T.StructField(p + "run", T.LongType()), T.StructField(p + "place", T.LongType()), T.StructField(p + "edge", T.BooleanType())])


def sorted_rows(docs: DataFrame, partitions: int, keep: str, p: str = P) -> DataFrame:
    """``docs`` in content order with key columns; the row to keep comes first among equals."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({p + "text": text, p + "head": F.substring(text, 1, 32), p + "hash": F.xxhash64(text), p + "sha": F.sha2(text, 256)})
    by_id = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    head = [p + "head", p + "hash"]
    return keyed.repartitionByRange(partitions, *head, by_id).sortWithinPartitions(*head, p + "text", by_id)


def _marked(names: list[str], p: str = P):
    """A function that gives each row its run of equal texts, by comparing neighbours in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, at, place, waiting = None, -1, 0, None
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            if batch is not None:
                text = batch.column(batch.schema.get_field_index(p + "text"))
                new = np.ones(len(text), bool)
                new[0] = last is None or not text[0].equals(last)
                if len(text) > 1:
                    new[1:] = pc.not_equal(text.slice(1), text.slice(0, len(text) - 1)).to_numpy(zero_copy_only=False)
                runs = at + np.cumsum(new)
                index = np.arange(len(text))
                begun = np.maximum.accumulate(np.where(new, index, -1))
                places = np.where(begun >= 0, index - begun, place + index)
                last, at, place = text[-1], int(runs[-1]), int(places[-1]) + 1
            if waiting is not None:  # the last run is known only at the end: a batch waits for its successor
                yield _give(waiting, names, p, part, at if batch is None else None)
            waiting = None if batch is None else (batch, runs, places)

    return run


def _give(waiting: tuple, names: list[str], p: str, part: int, last_run: int | None) -> pa.RecordBatch:
    batch, runs, places = waiting
    edge = runs == 0
    if last_run is not None:
        edge |= runs == last_run
    given = [pa.array(np.full(len(runs), part, np.int64)), pa.array(runs.astype(np.int64)), pa.array(places.astype(np.int64)), pa.array(edge)]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), *given], names=[*names, *marks(p).names])


def default_partitions(docs: DataFrame) -> int:
    return partitions_for(docs, "text")


def decisions(docs: DataFrame, keep: str = "largest", partitions: int | None = None) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = docs.select("doc_id", "text")
    rows = sorted_rows(docs, partitions or default_partitions(docs), keep)
    names = ["doc_id", P + "sha"]
    schema = T.StructType([docs.schema["doc_id"], T.StructField(P + "sha", T.StringType()), *marks(P).fields])
    marked = stored(rows.select("doc_id", P + "text", P + "sha").mapInArrow(_marked(names), schema), "content-sort")
    best = F.max("doc_id") if keep == "largest" else F.min("doc_id")
    # a run is whole within its partition, but for those that may go on over an edge
    key = [P + "part", P + "run"]
    runs = marked.groupBy(*key).agg(best.alias("keep_id"), F.count("*").alias("group_size"), F.first(P + "sha").alias("sha"), F.max(P + "edge").alias("edge"), F.min(P + "part").alias("p"))
    runs = stored(runs, "content-runs")
    over = runs.filter("edge").groupBy("sha").agg(best_of(keep, "keep_id").alias("k"), F.sum("group_size").alias("g"), F.min("p").alias("first_part"))
    runs = runs.join(over, (runs["sha"] == over["sha"]) & runs["edge"], "left").select(
        *key, F.coalesce("k", "keep_id").alias("keep_id"), F.coalesce("g", "group_size").alias("group_size"), (F.coalesce("first_part", "p") == F.col("p")).alias("begins")
    )
    return marked.join(runs, key).select(
        "doc_id", "keep_id", "group_size", (F.col("begins") & (F.col(P + "place") == 0)).alias("kept"), F.col(P + "sha").alias("text_sha256")
    )


def best_of(keep: str, column: str):
    return F.max(column) if keep == "largest" else F.min(column)


def distinct_rows(docs: DataFrame, keep: str = "largest", partitions: int | None = None) -> DataFrame:
    """The row of each group of equal texts that stays, with all its columns.

    The first row of each run is written. A run that crosses an edge has such a
    row in several partitions, of which the first counts; there are fewer of
    these runs than partitions, so their list is broadcast."""
    p = free_prefix(docs, P)
    rows = sorted_rows(docs, partitions or default_partitions(docs), keep, p)
    schema = T.StructType([*docs.schema.fields, T.StructField(p + "sha", T.StringType()), *marks(p).fields])
    rows = rows.drop(p + "head", p + "hash")
    heads = rows.mapInArrow(_marked(schema.names[: -len(marks(p).fields)], p), schema).filter(F.col(p + "place") == 0)
    heads = stored(heads, "content-heads")
    firsts = heads.groupBy(p + "sha").agg(F.min(p + "part").alias(p + "first"), F.count("*").alias(p + "n")).filter(F.col(p + "n") > 1)
    kept = heads.join(F.broadcast(firsts), p + "sha", "left").filter(F.col(p + "first").isNull() | (F.col(p + "part") == F.col(p + "first")))
    return kept.select(*docs.columns)
