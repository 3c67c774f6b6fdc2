"""The test tables seen as fragments, alignments, targets and reads.

A line item is an alignment, its order the fragment, its supplier's nation the target, the region the gene."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import clean
from ..operators import mapping


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, suppliers = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("frag"), F.col("s_nationkey").cast("int").alias("tid"), F.col("l_linenumber").cast("int").alias("ln"), F.col("l_quantity").cast("int").alias("score"),
        (F.col("l_linestatus") == "O").alias("fwd"), F.col("l_returnflag").isin("A", "N").alias("mate_fwd"), (F.col("l_partkey") % 400).cast("int").alias("pos"),
        (F.col("l_suppkey") * 3).cast("int").alias("mate_pos"), (F.col("s_nationkey") >= 23).alias("decoy"), (500 + 37 * F.col("s_nationkey")).cast("int").alias("len"), F.col("l_partkey").alias("part"),
    )


ALN = """aln AS (SELECT l_orderkey AS frag, CAST(s_nationkey AS INTEGER) AS tid, CAST(l_linenumber AS INTEGER) AS ln, CAST(l_quantity AS INTEGER) AS score, l_linestatus = 'O' AS fwd,
    l_returnflag IN ('A', 'N') AS mate_fwd, CAST(l_partkey % 400 AS INTEGER) AS pos, CAST(l_suppkey * 3 AS INTEGER) AS mate_pos, s_nationkey >= 23 AS decoy,
    CAST(500 + 37 * s_nationkey AS INTEGER) AS len, l_partkey AS part FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.best_per_target(alignments(spark, sf_dir).repartition("frag"), F.col("fwd"))  # serves what looks at whole fragments, too


BEST = f"""{ALN}, best AS (SELECT * FROM aln QUALIFY row_number() OVER (PARTITION BY frag, tid ORDER BY score DESC, fwd DESC, ln DESC) = 1)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frag, tid, w): weights by score, 1 in all for each fragment."""
    soft = mapping.soft_filter(best(spark, sf_dir), 0.1, 0.0)
    whole = F.sum("p").over(mapping.Window.partitionBy("frag"))
    return soft.select("frag", "tid", (F.col("p") / whole).alias("w"))


HITS = f"""{BEST}, scored AS (SELECT frag, tid, exp((score - max(score) OVER (PARTITION BY frag)) * 0.1) AS p FROM best),
    hits AS (SELECT frag, tid, p / sum(p) OVER (PARTITION BY frag) AS w FROM scored)"""

LABELS = f"""{HITS}, lab AS (SELECT frag, string_agg(CAST(tid AS VARCHAR), ',' ORDER BY tid) AS label,
    string_agg(CAST(tid AS VARCHAR), ',' ORDER BY w, tid) AS ranked,
    string_agg(CAST(tid AS VARCHAR), ',' ORDER BY tid) || '|' || string_agg(CAST(CAST(floor(w * rc) AS BIGINT) AS VARCHAR), ',' ORDER BY tid) AS key
    FROM (SELECT *, floor(sqrt(CAST(count(*) OVER (PARTITION BY frag) AS DOUBLE)) + 4) AS rc FROM hits) GROUP BY frag)"""

CLASSES = f"""{LABELS}, cls AS (SELECT label AS key, count(*) AS n FROM lab GROUP BY 1), mem AS (SELECT key, n, CAST(unnest(string_split(key, ',')) AS INTEGER) AS tid FROM cls)"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("tid"), F.col("n_name").alias("name"), (500 + 37 * F.col("n_nationkey")).cast("int").alias("len"), F.col("n_regionkey").cast("int").alias("region"))


TARGETS = "targets AS (SELECT CAST(n_nationkey AS INTEGER) AS tid, n_name AS name, CAST(500 + 37 * n_nationkey AS INTEGER) AS len, CAST(n_regionkey AS INTEGER) AS region FROM nation)"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("tid"), clean(F.col("text")).alias("seq"))


SEQS = "seqs AS (SELECT doc_id AS tid, upper(regexp_replace(text, '[^acgtACGT]', '', 'g')) AS seq FROM documents)"


def fragment_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark, sf_dir).select((50 + F.col("score") * 10).alias("length"))


HIST = f"{ALN}, hist AS (SELECT CAST(least(50 + score * 10, 1000) AS INTEGER) AS length, count(*) AS n FROM aln GROUP BY 1)"
DIST = f"""{HIST}, dist AS (SELECT length, n / sum(n) OVER () AS p, sum(n) OVER w / sum(n) OVER () AS c, sum(n * length) OVER w / CAST(sum(n) OVER w AS DOUBLE) AS mean
    FROM (SELECT e.i::INTEGER AS length, coalesce(n, 0)::DOUBLE AS n FROM range(1001) e(i) LEFT JOIN hist ON length = e.i) WINDOW w AS (ORDER BY length ROWS UNBOUNDED PRECEDING))"""
DIST_AFTER_ALN = DIST[len(ALN) + 2 :]  # where alignments are there already


def cigar_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frag, ln, side, w, cigar, read, ref): each line item lies on the sequence of the document with its part's number,
    with a clipped front, a deletion and an insertion; every tenth letter of what is aligned is overwritten."""
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frag"), F.col("l_linenumber").cast("int").alias("ln"), F.col("l_partkey").alias("tid"), F.col("l_quantity").cast("int").alias("q"),
        (F.col("l_partkey") % 3 + 1).cast("int").alias("d"), (F.col("l_suppkey") % 4 + 1).cast("int").alias("i"),
    )
    span = 2 * F.col("q") + F.col("d")
    # merged, not broadcast: a text is cleaned before the join, and not again for each line item
    rows = lines.join(sequences(spark, sf_dir).filter(F.length("seq") >= 120).hint("merge"), "tid")
    at = ((F.col("frag") * 7 + F.col("ln")) % (F.length("seq") - span + 1)).cast("int")
    rows = rows.withColumn("ref", F.substring("seq", at + 1, span))
    worn = lambda c: F.regexp_replace(c, "(.{9}).", "$1A")
    text = F.concat(F.repeat(F.lit("C"), F.col("ln")), worn(F.substring("ref", F.lit(1), F.col("q"))), F.repeat(F.lit("G"), F.col("i")), worn(F.substring("ref", F.col("q") + F.col("d") + 1, F.col("q"))))
    cigar = F.concat_ws("", "ln", F.lit("S"), "q", F.lit("M"), "d", F.lit("D"), "i", F.lit("I"), "q", F.lit("M"))
    return rows.select("frag", "ln", (F.col("ln") % 2).alias("side"), (1.0 / F.col("ln")).alias("w"), cigar.alias("cigar"), text.alias("read"), "ref", F.col("q"), F.col("d"), F.col("i"))


CIGARS = f"""{SEQS}, cg AS (SELECT row_number() OVER () AS rid, l_orderkey AS frag, CAST(l_linenumber AS INTEGER) AS ln, CAST(l_quantity AS INTEGER) AS q, CAST(l_partkey % 3 + 1 AS INTEGER) AS d, CAST(l_suppkey % 4 + 1 AS INTEGER) AS i, seq
        FROM lineitem JOIN seqs ON tid = l_partkey WHERE length(seq) >= 120),
    cr AS (SELECT *, substr(seq, CAST((frag * 7 + ln) % (length(seq) - (2 * q + d) + 1) + 1 AS BIGINT), 2 * q + d) AS ref FROM cg),
    ca AS (SELECT rid, frag, ln, ln % 2 AS side, 1.0 / ln AS w, q, d, i, ref, repeat('C', ln) || regexp_replace(substr(ref, 1, q), '(.{{9}}).', '\\1A', 'g') || repeat('G', i) || regexp_replace(substr(ref, q + d + 1, q), '(.{{9}}).', '\\1A', 'g') AS read FROM cr)"""
