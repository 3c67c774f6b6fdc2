"""Thin adapters: each query applies operators to the frames of a data set; beside it stands its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import formats
from ..functions import sequences as seq
from ..functions.numeric import digamma_sql, log_add
from ..operators import abundance, bias, cells, classes, errors, graph, inference, kmers, lengths, likelihood, mapping
from ..store import stored
from .frames import ALN, BEST, CIGARS, CLASSES, DIST, DIST_AFTER_ALN, HIST, HITS, LABELS, SEQS, TARGETS, alignments, best, cigar_alignments, fragment_lengths, hits, read, sequences, targets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- classes


def labelled(spark, d, **how):
    return classes.labels(hits(spark, d), **how)


@query(f"WITH {CLASSES} SELECT key, n FROM cls")
def eqclass_build(spark, d):
    return classes.counts(labelled(spark, d))


@query(f"WITH {LABELS} SELECT key, count(*) AS n FROM lab GROUP BY 1")
def eqclass_range_factorized(spark, d):
    return classes.counts(labelled(spark, d, bins=4), "key")


@query(f"WITH {CLASSES} SELECT key, n FROM cls")
def eqclass_collapse(spark, d):
    return classes.collapse(eqclass_range_factorized(spark, d))


@query(f"WITH {LABELS} SELECT ranked AS key, count(*) AS n FROM lab GROUP BY 1")
def eqclass_rank_ordered(spark, d):
    return classes.counts(labelled(spark, d, by_weight=True))


@query(f"""WITH {LABELS}, s AS (SELECT label AS key, tid, sum(w) AS s FROM hits JOIN lab USING (frag) GROUP BY 1, 2)
    SELECT key, tid, round(s / sum(s) OVER (PARTITION BY key), 6) AS w FROM s""")
def eqclass_weights(spark, d):
    return classes.weights(hits(spark, d), labelled(spark, d)).withColumn("w", F.round("w", 6))


@query(f"""WITH {CLASSES}, {TARGETS} SELECT t.tid, CAST(coalesce(sum(n) FILTER (WHERE key NOT LIKE '%,%'), 0) AS BIGINT) AS unique_count,
    CAST(coalesce(sum(n) FILTER (WHERE key LIKE '%,%'), 0) AS BIGINT) AS ambig_count FROM targets t LEFT JOIN mem ON mem.tid = t.tid GROUP BY 1""")
def ambiguity_counts(spark, d):
    return classes.ambiguity(eqclass_build(spark, d), targets(spark, d))


_TARGET_COUNTS = f"""WITH {ALN}, ft AS (SELECT DISTINCT frag, tid FROM aln), k AS (SELECT frag, count(*) AS k FROM ft GROUP BY 1)
    SELECT tid, count(*) AS total, count(*) FILTER (WHERE k = 1) AS uniq FROM ft JOIN k USING (frag) GROUP BY 1"""


@query(_TARGET_COUNTS)
def unique_total_counts(spark, d):
    return classes.target_counts(alignments(spark, d))


@query(f"WITH {ALN} SELECT frag, min(tid) AS tid FROM aln GROUP BY 1 HAVING count(DISTINCT tid) = 1")
def uniquely_mapped(spark, d):
    return alignments(spark, d).groupBy("frag").agg(F.min("tid").alias("tid"), F.max("tid").alias("top")).filter("tid = top").select("frag", "tid")


@query(f"""WITH {CLASSES}, a AS (SELECT tid, CASE WHEN tid % 2 = 0 THEN 1.0 ELSE 0.0 END AS alpha FROM (SELECT DISTINCT tid FROM mem))
    SELECT key FROM mem JOIN a USING (tid) GROUP BY 1 HAVING sum(alpha) <= 0""")
def degenerate_classes(spark, d):
    m = classes.members(eqclass_build(spark, d)).withColumn("w", F.lit(1.0))
    alpha = m.select("tid").distinct().withColumn("alpha", F.when(F.col("tid") % 2 == 0, 1.0).otherwise(0.0))
    return classes.degenerate(m, alpha)


# --- inference

ROUNDS = 20
_EM = f"""{CLASSES}, em(it, tid, a) AS (SELECT 0, tid, 1.0::DOUBLE FROM (SELECT DISTINCT tid FROM mem) UNION ALL
    SELECT it + 1, tid, sum(n * a / den) FROM (SELECT it, m.tid, m.n, em.a, sum(em.a) OVER (PARTITION BY m.key) AS den FROM mem m JOIN em ON em.tid = m.tid WHERE it < {ROUNDS}) GROUP BY it, tid)"""


def equal_members(spark, d):
    return stored(classes.members(eqclass_build(spark, d)).withColumn("w", F.lit(1.0)), "members")


def em(spark, d):
    return inference.expectation_maximisation(equal_members(spark, d), ROUNDS)


@query(f"WITH RECURSIVE {_EM} SELECT tid, round(a, 4) AS alpha FROM em WHERE it = {ROUNDS}")
def em_fixed_rounds(spark, d):
    return em(spark, d).select("tid", F.round("alpha", 4).alias("alpha"))


_WEIGHTS = f"""{CLASSES}, ws AS (SELECT label AS key, tid, sum(w) AS s FROM hits JOIN lab USING (frag) GROUP BY 1, 2), cw AS (SELECT key, tid, s / sum(s) OVER (PARTITION BY key) AS w FROM ws)"""
_LENGTHS = f"{DIST_AFTER_ALN}, {TARGETS}, el AS (SELECT tid, CASE WHEN len - coalesce(mean, 0) < 1 THEN len ELSE len - coalesce(mean, 0) END AS eff_len FROM targets LEFT JOIN dist ON least(len, 1000) = length)"
_WEIGHTED_ROUNDS = """UNION ALL SELECT it + 1, tid, sum(n * x / den) FROM (SELECT it, m.tid, m.n, em.a * m.w AS x, sum(em.a * m.w) OVER (PARTITION BY m.key) AS den FROM {0} m JOIN em ON em.tid = m.tid WHERE it < 20) GROUP BY it, tid)"""
_START = """pj AS (SELECT tid, sum(n * 1.0 / k) AS projected FROM (SELECT *, count(*) OVER (PARTITION BY key) AS k FROM mem) GROUP BY 1),
    st AS (SELECT tid, projected * f + u * (1 - f) AS a FROM (SELECT *, least(0.999, sum(projected) OVER () / 5e7) AS f, avg(projected) OVER () AS u FROM pj))"""


def class_weights(spark, d):
    """(key, tid, w, n), stored: what follows reads the classes and not the line items again."""
    return stored(classes.weighted_classes(hits(spark, d)), "classes")


def class_counts(weighted):
    return weighted.groupBy("key").agg(F.max("n").alias("n"))


def target_lengths(spark, d):
    return lengths.effective_lengths(targets(spark, d), dist(spark, d)).select("tid", "eff_len")


@query(f"WITH {_WEIGHTS}, {_LENGTHS} SELECT key, tid, round(w / greatest(eff_len, 1) / sum(w / greatest(eff_len, 1)) OVER (PARTITION BY key), 8) AS w FROM cw JOIN el USING (tid)")
def combined_weights(spark, d):
    return classes.length_weights(class_weights(spark, d), target_lengths(spark, d)).select("key", "tid", F.round("w", 8).alias("w"))


def even_shares(members):
    """(tid, projected): each class dealt evenly."""
    k = F.count("*").over(Window.partitionBy("key"))
    return members.withColumn("p", F.col("n") / k).groupBy("tid").agg(F.sum("p").alias("projected"))


@query(f"WITH {CLASSES}, {_START} SELECT tid, round(a, 4) AS alpha FROM st")
def start_abundance(spark, d):
    return inference.start(even_shares(classes.members(eqclass_build(spark, d)))).withColumn("alpha", F.round("alpha", 4))


@query(f"""WITH RECURSIVE {_WEIGHTS}, {_LENGTHS}, cm AS (SELECT key, n, tid, w / greatest(eff_len, 1) / sum(w / greatest(eff_len, 1)) OVER (PARTITION BY key) AS w FROM cw JOIN el USING (tid) JOIN cls USING (key)), {_START},
    em(it, tid, a) AS (SELECT 0, tid, a::DOUBLE FROM st {_WEIGHTED_ROUNDS.format('cm')} SELECT tid, round(a, 3) AS alpha FROM em WHERE it = 20""")
def em_weighted(spark, d):
    """Weights by alignment and effective length, from the mixed start."""
    m = stored(classes.length_weights(class_weights(spark, d), target_lengths(spark, d)), "members")
    return inference.expectation_maximisation(m, ROUNDS, start=inference.start(even_shares(m))).withColumn("alpha", F.round("alpha", 3))


@query(f"""WITH RECURSIVE {_WEIGHTS}, cm AS (SELECT key, n, tid, w FROM cw JOIN cls USING (key)), em(it, tid, a) AS (SELECT 0, tid, 1.0::DOUBLE FROM (SELECT DISTINCT tid FROM cm) {_WEIGHTED_ROUNDS.format('cm')}
    SELECT n_name AS name, round(a, 3) AS num_reads FROM em JOIN nation ON n_nationkey = tid WHERE it = 20""")
def quant_from_classes(spark, d):
    """Classes written as files and read back; their weights are taken as they are, from an even start."""
    from ..sources import readers, writers
    from ..store import new_path

    path = new_path(spark, "classes")
    weighted = class_weights(spark, d)
    writers.write_classes(class_counts(weighted), targets(spark, d), path, weighted)
    names, members = readers.read_class_tables(spark, path)
    return inference.expectation_maximisation(members, ROUNDS).join(names, "tid").select("name", F.round("alpha", 3).alias("num_reads"))


@query(SQL["quant_from_classes"])
def quant_class_file(spark, d):
    """The same by way of a class file, one list of lines, with targets numbered 5, 15, 25 and so on."""
    from ..sources import readers, writers
    from ..store import new_path

    path, own = new_path(spark, "class-file"), F.col("tid") * 10 + 5
    weighted = class_weights(spark, d)
    other = F.array_join(F.transform(F.split("key", ","), lambda t: (t.cast("int") * 10 + 5).cast("string")), ",")
    counts = class_counts(weighted).withColumn("key", other)
    writers.write_class_file(counts, targets(spark, d).withColumn("tid", own), path, weighted.withColumn("key", other).withColumn("tid", own))
    names, n, members = readers.read_classes(spark, path)
    members = members.join(n, "class_id").select(F.col("class_id").cast("string").alias("key"), "n", "tid", "w")
    return inference.expectation_maximisation(stored(members, "members"), ROUNDS).join(names, "tid").select("name", F.round("alpha", 3).alias("num_reads"))


_VB_ROUNDS, _PRIOR = 8, 0.01
_THETA = f"exp({digamma_sql(f'a + {_PRIOR}')} - {digamma_sql('s')})"


@query(f"""WITH RECURSIVE {CLASSES}, vb(it, tid, a) AS (SELECT 0, tid, 1.0::DOUBLE FROM (SELECT DISTINCT tid FROM mem) UNION ALL
    SELECT it + 1, tid, sum(n * th / den) FROM (SELECT it, m.tid, m.n, th, sum(th) OVER (PARTITION BY m.key) AS den FROM mem m JOIN
        (SELECT it, tid, {_THETA} AS th FROM (SELECT it, tid, a, sum(a + {_PRIOR}) OVER () AS s FROM vb)) v ON v.tid = m.tid WHERE it < {_VB_ROUNDS}) GROUP BY it, tid)
    SELECT tid, round(a, 4) AS alpha FROM vb WHERE it = {_VB_ROUNDS}""")
def vbem_fixed_rounds(spark, d):
    return inference.expectation_maximisation(equal_members(spark, d), _VB_ROUNDS, prior=_PRIOR).select("tid", F.round("alpha", 4).alias("alpha"))


@query(f"""WITH RECURSIVE {CLASSES}, {_LENGTHS}, pr AS (SELECT tid, eff_len * 1e-3 AS pr FROM el), vb(it, tid, a) AS (SELECT 0, tid, 1.0::DOUBLE FROM (SELECT DISTINCT tid FROM mem) UNION ALL
    SELECT it + 1, tid, sum(n * th / den) FROM (SELECT it, m.tid, m.n, th, sum(th) OVER (PARTITION BY m.key) AS den FROM mem m JOIN
        (SELECT it, tid, exp({digamma_sql('b')} - {digamma_sql('s')}) AS th FROM (SELECT it, tid, b, sum(b) OVER () AS s FROM (SELECT it, tid, a + pr AS b FROM vb JOIN pr USING (tid)))) v ON v.tid = m.tid WHERE it < {_VB_ROUNDS}) GROUP BY it, tid)
    SELECT tid, round(a, 4) AS alpha FROM vb WHERE it = {_VB_ROUNDS}""")
def vbem_per_nucleotide(spark, d):
    prior = inference.per_nucleotide(target_lengths(spark, d), 1e-3)
    return inference.expectation_maximisation(equal_members(spark, d), _VB_ROUNDS, prior=prior).select("tid", F.round("alpha", 4).alias("alpha"))


@query()
def em_until_settled(spark, d):
    return inference.truncate(inference.expectation_maximisation(equal_members(spark, d), 10_000, tolerance=0.01, least_rounds=100))


def counted(spark, d):
    t = targets(spark, d).select("tid", "name", F.col("len").alias("length"), (F.col("len") - 100.0).alias("eff_len"))
    return t.join(em(spark, d), "tid").withColumnRenamed("alpha", "num_reads")


_COUNTED = f"""{_EM}, {TARGETS}, counted AS (SELECT tid, name, len AS length, len - 100.0::DOUBLE AS eff_len, a AS num_reads FROM targets JOIN em USING (tid) WHERE it = {ROUNDS}),
    ab AS (SELECT *, num_reads / eff_len / sum(num_reads / eff_len) OVER () * 1e6 AS tpm FROM counted)"""


@query(f"WITH RECURSIVE {_COUNTED} SELECT tid, round(tpm, 3) AS tpm FROM ab")
def tpm(spark, d):
    return abundance.tpm(counted(spark, d)).select("tid", F.round("tpm", 3).alias("tpm"))


@query(f"WITH RECURSIVE {_COUNTED} SELECT name, length, round(eff_len, 2) AS effective_length, round(tpm, 3) AS tpm, round(num_reads, 2) AS num_reads FROM ab")
def abundance_table(spark, d):
    return abundance.table(counted(spark, d), digits=2, tpm_digits=3)


@query(f"WITH RECURSIVE {_EM} SELECT tid, CASE WHEN round(a, 4) <= 2000 THEN 0.0 ELSE round(a, 4) END AS alpha FROM em WHERE it = {ROUNDS}")
def truncate_abundance(spark, d):
    return inference.truncate(em_fixed_rounds(spark, d), 2000.0)


@query(f"WITH {TARGETS} SELECT name, len AS length, CAST(len AS DOUBLE) AS effective_length, 0.0::DOUBLE AS tpm, 0.0::DOUBLE AS num_reads FROM targets")
def empty_abundance(spark, d):
    return abundance.empty_table(targets(spark, d).select("name", F.col("len").alias("length")))


_GENES = """SELECT gene, round(CASE WHEN sum(tpm) > 0 THEN sum(length * tpm) / sum(tpm) ELSE avg(length) END, 3) AS length,
    round(CASE WHEN sum(tpm) > 0 THEN sum(eff_len * tpm) / sum(tpm) ELSE avg(eff_len) END, 3) AS effective_length, round(sum(tpm), 3) AS tpm, round(sum(num_reads), 3) AS num_reads"""


def _genes(spark, d, genes):
    ab = abundance.tpm(counted(spark, d)).select("name", "length", F.col("eff_len").alias("effective_length"), "tpm", "num_reads")
    t = abundance.gene_table(ab, genes)
    return t.select("gene", *(F.round(c, 3).alias(c) for c in ("length", "effective_length", "tpm", "num_reads")))


@query(f"WITH RECURSIVE {_COUNTED} {_GENES} FROM (SELECT ab.*, r_name AS gene FROM ab JOIN nation ON n_name = ab.name JOIN region ON r_regionkey = n_regionkey) GROUP BY gene")
def gene_rollup(spark, d):
    genes = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("gene"))
    return _genes(spark, d, genes)


@query(f"""WITH RECURSIVE {_COUNTED} {_GENES} FROM (SELECT ab.*, coalesce(r_name, ab.name) AS gene FROM ab JOIN nation ON n_name = ab.name
    LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey < 2) GROUP BY gene""")
def gene_rollup_unmapped(spark, d):
    genes = read(spark, d, "nation").join(read(spark, d, "region").filter("r_regionkey < 2"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("gene"))
    return _genes(spark, d, genes)


def _samples(spark, d, gaps):
    rows = read(spark, d, "lineitem").join(read(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.groupBy(F.col("p_brand").alias("name"), F.col("l_returnflag").alias("sample")).agg(F.sum("l_quantity").cast("long").alias("value"))
    return rows.filter(~((F.col("sample") == "A") & F.col("name").endswith("1"))) if gaps else rows


_SAMPLES = "s AS (SELECT p_brand AS name, l_returnflag AS sample, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
_PIVOT = ", ".join(f"coalesce(max(CAST(value AS VARCHAR)) FILTER (WHERE sample = '{x}'), 'NA') AS \"{x}\"" for x in "ANR")


@query(f"WITH {_SAMPLES} SELECT name, {_PIVOT} FROM s GROUP BY name")
def quantmerge_pivot(spark, d):
    return abundance.merge_long(_samples(spark, d, False), list("ANR"))


@query(f"WITH {_SAMPLES} SELECT name, {_PIVOT} FROM s WHERE NOT (sample = 'A' AND name LIKE '%1') GROUP BY name")
def quantmerge_missing(spark, d):
    return abundance.merge_long(_samples(spark, d, True), list("ANR"))


@query(f"""WITH {_SAMPLES}, p AS (SELECT name, sum(value) FILTER (WHERE sample = 'A')::DOUBLE AS a, sum(value) FILTER (WHERE sample = 'R')::DOUBLE AS b FROM s GROUP BY 1),
    r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM p)
    SELECT round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM r""")
def sim_correlation(spark, d):
    s = _samples(spark, d, False).groupBy("name").agg(*(F.sum(F.when(F.col("sample") == x, F.col("value"))).cast("double").alias(c) for x, c in (("A", "a"), ("R", "b"))))
    return abundance.correlation(s, "a", "b").select(F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


# --- formats

_OBSERVED = """CASE WHEN fwd = mate_fwd THEN 'M' WHEN (fwd AND pos <= mate_pos) OR (NOT fwd AND mate_pos <= pos) THEN 'I' ELSE 'O' END || CASE WHEN fwd THEN 'SF' ELSE 'SR' END"""


def observed(spark, d):
    a = alignments(spark, d)
    return a.withColumn("format", formats.observed_pair(F.col("fwd"), F.col("mate_fwd"), F.col("pos"), F.col("mate_pos")))


@query(f"WITH {ALN} SELECT frag, ln, {_OBSERVED} AS format FROM aln")
def observed_format(spark, d):
    return observed(spark, d).select("frag", "ln", "format")


@query(f"""WITH {ALN}, o AS (SELECT *, {_OBSERVED} AS format FROM aln)
    SELECT frag, ln, format LIKE 'I%' AS iu, format = 'ISF' AS isf, format LIKE 'M%' AS mu, fwd AS orphan_left, NOT fwd AS orphan_right FROM o""")
def compatibility(spark, d):
    o, f = observed(spark, d), F.col("format")
    left, right = (formats.compatible_single("ISF", F.col("fwd"), F.lit(m)) for m in ("left", "right"))
    return o.select("frag", "ln", *(formats.compatible_pair(c, f).alias(c.lower()) for c in ("IU", "ISF", "MU")), left.alias("orphan_left"), right.alias("orphan_right"))


_CODES = ", ".join(f"('{c}', '{k}', '{o}', '{t}')" for c, (k, o, t) in formats.FORMATS.items())
_KNOWN = f"codes(expected, kind, orientation, strand) AS (VALUES {_CODES})"


@query(f"""WITH {ALN}, {_KNOWN}, o AS (SELECT {_OBSERVED} AS observed, count(*) AS n FROM aln GROUP BY 1)
    SELECT expected, observed, n, expected = observed OR (expected IN ('IU', 'OU', 'MU') AND left(observed, 1) = left(expected, 1)) AS compatible FROM codes, o""")
def compatible_formats(spark, d):
    """Every library format against every format that pairs have."""
    n = observed(spark, d).groupBy(F.col("format").alias("observed")).agg(F.count("*").alias("n"))
    one = lambda c: F.struct(F.lit(c).alias("expected"), formats.compatible_pair(c, F.col("observed")).alias("compatible"))
    return n.select("observed", "n", F.explode(F.array(*map(one, formats.FORMATS))).alias("x")).select("x.expected", "observed", "n", "x.compatible")


@query(f"""WITH {ALN}, {_KNOWN}, o AS (SELECT fwd, count(*) AS n FROM aln GROUP BY 1), m(mate) AS (VALUES ('single'), ('left'), ('right'))
    SELECT expected, fwd, mate, n, strand = 'U' OR CASE WHEN orientation = 'same' THEN fwd = (strand = 'S') WHEN strand IN ('S', 'SA') THEN fwd = (mate <> 'right') ELSE fwd = (mate = 'right') END AS compatible
    FROM codes, o, m WHERE (kind = 'single') = (mate = 'single')""")
def compatible_orphans(spark, d):
    """Every library format against reads without their mate: single ones, left and right ones."""
    n = alignments(spark, d).groupBy("fwd").agg(F.count("*").alias("n"))
    one = lambda c, m: F.struct(F.lit(c).alias("expected"), F.lit(m).alias("mate"), formats.compatible_single(c, F.col("fwd"), F.lit(m)).alias("compatible"))
    cases = [one(c, m) for c, (kind, _, _) in formats.FORMATS.items() for m in (("single",) if kind == "single" else ("left", "right"))]
    return n.select("fwd", "n", F.explode(F.array(*cases)).alias("x")).select("x.expected", "fwd", "x.mate", "n", "x.compatible")


@query(f"WITH {ALN}, o AS (SELECT *, {_OBSERVED} AS format FROM aln) SELECT frag, ln, round(CASE WHEN format = 'ISF' THEN 0.0 ELSE ln(1e-5) END, 6) AS log_p FROM o")
def format_prior(spark, d):
    return observed(spark, d).select("frag", "ln", F.round(formats.log_prior(formats.compatible_pair("ISF", F.col("format")), 1e-5), 6).alias("log_p"))


@query(f"""WITH {ALN} SELECT frag, ln, CAST(abs(pos - mate_pos) + CASE WHEN pos < mate_pos THEN 75 ELSE 100 END AS INTEGER) AS span,
    CAST(CASE WHEN fwd <> mate_fwd THEN abs(least(greatest(CASE WHEN fwd THEN pos ELSE mate_pos END, 0), len) - least(greatest(CASE WHEN fwd THEN mate_pos + 75 ELSE pos + 100 END, 0), len)) ELSE 0 END AS INTEGER) AS inner_span FROM aln""")
def pair_lengths(spark, d):
    """Fragment lengths of pairs of a read of 100 letters and a mate of 75."""
    c = {x: F.col(x) for x in ("fwd", "pos", "mate_fwd", "mate_pos", "len")}
    inner = formats.inner_length(c["fwd"], c["pos"], F.lit(100), c["mate_fwd"], c["mate_pos"], F.lit(75), c["len"])
    return alignments(spark, d).select("frag", "ln", formats.span_length(c["pos"], F.lit(100), c["mate_pos"], F.lit(75)).cast("int").alias("span"), inner.cast("int").alias("inner_span"))


@query(f"""WITH {ALN}, o AS (SELECT frag, {_OBSERVED} AS format FROM aln), f AS (SELECT frag, bool_or(format LIKE 'I%') AS ok, bool_or(format = 'ISF') AS sf, bool_or(format = 'ISR') AS sr FROM o GROUP BY 1),
    s AS (SELECT count(*) AS fragments, count(*) FILTER (WHERE ok) AS compatible, count(*) FILTER (WHERE sf) AS sense, count(*) FILTER (WHERE sr) AS antisense FROM f)
    SELECT 'IU' AS expected, fragments, compatible, round(compatible / fragments, 6) AS ratio, sense, antisense, round(abs(sense / (sense + antisense) - 0.5), 6) AS strand_bias,
        abs(sense / (sense + antisense) - 0.5) > 0.01 AS warn_strand, 1 - compatible / fragments > 0.05 AS warn_incompatible FROM s""")
def format_agreement(spark, d):
    from ..operators.reports import format_agreement as agreement

    return agreement(observed(spark, d), "IU").withColumns({c: F.round(c, 6) for c in ("ratio", "strand_bias")})


@query(f"""WITH {ALN}, o AS (SELECT {_OBSERVED} AS format FROM (SELECT * FROM aln ORDER BY frag, ln LIMIT 50000)),
    c AS (SELECT count(*) FILTER (WHERE format LIKE 'I%') AS i, count(*) FILTER (WHERE format LIKE 'O%') AS u, count(*) FILTER (WHERE format LIKE 'M%') AS m, avg(CASE WHEN format LIKE '%F' THEN 1.0 ELSE 0.0 END) AS f FROM o)
    SELECT CASE WHEN i >= u AND i >= m THEN 'I' WHEN u >= m THEN 'O' ELSE 'M' END || CASE WHEN f < 0.3 THEN 'SR' WHEN f < 0.7 THEN 'U' ELSE 'SF' END AS detected FROM c""")
def libtype_detect(spark, d):
    """The format of most of the first 50,000 alignments; a share of forward ones below 0.3 or from 0.7 on makes it stranded."""
    first = observed(spark, d).orderBy("frag", "ln").limit(50_000)
    n = lambda x: F.count_if(F.col("format").startswith(x))
    c = first.agg(n("I").alias("i"), n("O").alias("o"), n("M").alias("m"), F.avg(F.when(F.col("format").endswith("F"), 1.0).otherwise(0.0)).alias("f"))
    kind = F.when((F.col("i") >= F.col("o")) & (F.col("i") >= F.col("m")), "I").when(F.col("o") >= F.col("m"), "O").otherwise("M")
    return c.select(F.concat(kind, F.when(F.col("f") < 0.3, "SR").when(F.col("f") < 0.7, "U").otherwise("SF")).alias("detected"))


@query(f"""WITH {ALN} SELECT {_OBSERVED} AS format, count(*) AS alignments, count(DISTINCT frag) AS fragments, round(avg(CASE WHEN fwd THEN 1.0 ELSE 0.0 END), 6) AS forward FROM aln GROUP BY 1""")
def libtype_report(spark, d):
    return observed(spark, d).groupBy("format").agg(F.count("*").alias("alignments"), F.countDistinct("frag").alias("fragments"), F.round(F.avg(F.when(F.col("fwd"), 1.0).otherwise(0.0)), 6).alias("forward"))


@query(f"WITH {ALN} SELECT count(DISTINCT frag) AS mapped, (SELECT count(*) FROM orders) AS fragments, round(count(DISTINCT frag)::DOUBLE / (SELECT count(*) FROM orders), 6) AS rate FROM aln")
def mapping_rate(spark, d):
    mapped = alignments(spark, d).agg(F.countDistinct("frag").alias("mapped"))
    both = mapped.crossJoin(read(spark, d, "orders").agg(F.count("*").alias("fragments")))  # one row each
    return both.withColumn("rate", F.round(F.col("mapped") / F.nullif(F.col("fragments"), F.lit(0)), 6))


# --- lengths


@query(f"WITH {HIST} SELECT length, n FROM hist")
def fld_histogram(spark, d):
    return lengths.histogram(fragment_lengths(spark, d))


@query(f"""WITH {HIST} SELECT length + d.i - 2 AS length, round(sum(n * k / 16.0), 4) AS mass FROM hist, (VALUES (0, 1), (1, 4), (2, 6), (3, 4), (4, 1)) d(i, k)
    WHERE length + d.i - 2 BETWEEN 0 AND 1000 GROUP BY 1""")
def fld_kernel_smooth(spark, d):
    return lengths.smooth(fld_histogram(spark, d)).withColumn("mass", F.round("mass", 4))


def dist(spark, d):
    return lengths.distribution(lengths.dense(fld_histogram(spark, d), 1000))


@query(f"WITH {DIST} SELECT length, round(c, 6) AS c FROM dist")
def fld_cmf(spark, d):
    return dist(spark, d).select("length", F.round("c", 6).alias("c"))


@query(f"""WITH {DIST}, dr AS (SELECT i, (CAST('0x' || substr(md5(CAST(i AS VARCHAR) || ':1'), 1, 8) AS BIGINT)::DOUBLE + 0.5) / 4294967296 AS u FROM range(10000) t(i)),
    le AS (SELECT i, (SELECT count(*) FROM dist WHERE c <= u) AS n FROM dr) SELECT CAST(least(n, 1000) AS INTEGER) AS length, count(*) AS n FROM le GROUP BY 1""")
def length_sample(spark, d):
    from ..sources.writers import length_sample as sample

    return sample(dist(spark, d).select("length", "c"))


@query(f"WITH {DIST} SELECT length, round(mean, 4) AS mean FROM dist WHERE c > 0")
def conditional_means(spark, d):
    return dist(spark, d).filter("c > 0").select("length", F.round("mean", 4).alias("mean"))


@query(f"""WITH {DIST}, {TARGETS} SELECT tid, round(CASE WHEN len - coalesce(mean, 0) < 1 THEN len ELSE len - coalesce(mean, 0) END, 4) AS eff_len FROM targets LEFT JOIN dist ON least(len, 1000) = length""")
def effective_length(spark, d):
    return lengths.effective_lengths(targets(spark, d), dist(spark, d)).select("tid", F.round("eff_len", 4).alias("eff_len"))


@query(f"WITH {DIST}, {TARGETS} SELECT tid, round(sum(p * (len - length + 1)), 4) AS eff_len FROM targets JOIN dist ON length <= len GROUP BY 1")
def exact_effective_length(spark, d):
    return lengths.exact_effective_lengths(targets(spark, d), dist(spark, d)).withColumn("eff_len", F.round("eff_len", 4))


@query(f"""WITH {DIST}, {TARGETS} SELECT tid, round(ln(a.c) - ln(b.c), 6) AS log_p FROM targets JOIN dist a ON a.length = least(len // 3, 1000) JOIN dist b ON b.length = least(len, 1000)""")
def ambig_length_prob(spark, d):
    c = dist(spark, d).select("length", "c")
    t = targets(spark, d).join(c.select(F.col("length").alias("la"), F.col("c").alias("ca")), F.least(F.floor(F.col("len") / 3), F.lit(1000)) == F.col("la"))
    t = t.join(c.select(F.col("length").alias("lb"), F.col("c").alias("cb")), F.least("len", F.lit(1000)) == F.col("lb"))
    return t.select("tid", F.round(likelihood.log_ambiguous_length(F.col("ca"), F.col("cb")), 6).alias("log_p"))


@query(f"""WITH {TARGETS}, r AS (SELECT tid, len, row_number() OVER (ORDER BY len, tid) AS r, count(*) OVER () AS n FROM targets)
    SELECT tid, CAST(least(4, (SELECT count(*) FROM r b WHERE b.r IN (5, 10, 15, 20) AND b.len <= r.len)) AS INTEGER) AS length_class FROM r""")
def length_quantile_classes(spark, d):
    return lengths.length_classes(targets(spark, d)).select("tid", "length_class")


# --- choice of alignments


@query(f"WITH {BEST} SELECT frag, tid, ln, score FROM best")
def best_per_target(spark, d):
    return best(spark, d).select("frag", "tid", "ln", "score")


@query(f"""WITH {BEST}, s AS (SELECT frag, tid, exp(CAST(score - max(score) OVER (PARTITION BY frag) AS DOUBLE)) AS p FROM best) SELECT frag, tid, round(p, 6) AS p FROM s WHERE p >= 1e-5""")
def soft_filter(spark, d):
    return mapping.soft_filter(best(spark, d)).select("frag", "tid", F.round("p", 6).alias("p"))


@query(f"WITH {BEST} SELECT frag, tid FROM best QUALIFY score = max(score) OVER (PARTITION BY frag)")
def hard_filter(spark, d):
    return mapping.hard_filter(best(spark, d)).select("frag", "tid")


@query(f"""WITH {BEST}, x AS (SELECT *, max(score) FILTER (WHERE decoy) OVER (PARTITION BY frag) AS top FROM best) SELECT frag, tid, score FROM x WHERE NOT decoy AND (top IS NULL OR score >= top)""")
def decoy_filter(spark, d):
    return mapping.decoy_filter(best(spark, d)).select("frag", "tid", "score")


@query(f"""WITH {BEST}, x AS (SELECT *, max(score) FILTER (WHERE decoy) OVER (PARTITION BY frag) AS dm, max(score) FILTER (WHERE NOT decoy) OVER (PARTITION BY frag) AS tm FROM best)
    SELECT frag, tid, score FROM x WHERE decoy AND score = dm AND (tm IS NULL OR tm < dm)""")
def best_decoys(spark, d):
    return mapping.best_decoys(best(spark, d)).select("frag", "tid", "score")


@query(f"WITH {ALN} SELECT frag, ln, mate_pos < pos AND mate_pos + 75 >= pos AS dovetail FROM aln WHERE fwd AND NOT mate_fwd")
def dovetails(spark, d):
    a = alignments(spark, d).filter(F.col("fwd") & ~F.col("mate_fwd"))
    return a.select("frag", "ln", mapping.dovetails(F.col("pos"), F.col("mate_pos") + 75, F.col("mate_pos")).alias("dovetail"))


@query(f"""WITH {SEQS} SELECT sha256(string_agg(s, '' ORDER BY b)) AS sequences, sha256(string_agg(n, '' ORDER BY b)) AS names
    FROM (SELECT tid // 65536 AS b, sha256(string_agg(sha256(seq), '' ORDER BY tid)) AS s, sha256(string_agg(sha256(CAST(tid AS VARCHAR)), '' ORDER BY tid)) AS n FROM seqs GROUP BY 1)""")
def index_digests(spark, d):
    from ..operators.reports import digests

    return digests(sequences(spark, d).withColumn("name", F.col("tid").cast("string")))


@query(f"WITH {BEST} SELECT frag, tid FROM best QUALIFY count(*) OVER (PARTITION BY frag) <= 3")
def max_places_filter(spark, d):
    return mapping.most_places_filter(best(spark, d), 3).select("frag", "tid")


@query(f"WITH {ALN} SELECT frag, tid, fwd, mate_fwd, max(score) AS score FROM aln GROUP BY ALL")
def joint_hit_dedup(spark, d):
    return mapping.distinct_joint_hits(alignments(spark, d), ["frag", "tid", "fwd", "mate_fwd"], "score")


# --- likelihood

_LIKE = f"""{DIST}, f AS (SELECT frag, tid, ln, fwd, score, CASE WHEN x.fl <= x.len AND d.p > 0 AND c.c > 0 THEN ln(d.p) - ln(c.c) ELSE -24.0067 END
        + CASE WHEN x.fl <= x.len THEN -ln(CAST(greatest(x.len - x.fl + 1, 1) AS DOUBLE)) ELSE -24.0067 END + (score - 50) * 0.1 AS log_p
    FROM (SELECT *, 50 + score * 10 AS fl FROM aln) x LEFT JOIN dist d ON d.length = least(x.fl, 1000) LEFT JOIN dist c ON c.length = least(x.len, 1000)),
    e AS (SELECT *, exp(log_p - max(log_p) OVER (PARTITION BY frag)) AS e FROM f), post AS (SELECT *, e / sum(e) OVER (PARTITION BY frag) AS p FROM e)"""


def scored(spark, d):
    di = dist(spark, d)
    a = alignments(spark, d).withColumn("frag_len", 50 + F.col("score") * 10)
    a = likelihood.fragment_factor(a, di.select("length", "p"), di.select("length", "c"))
    return a.withColumn("log_p", F.col("log_fl") + likelihood.log_start(F.col("len"), F.col("frag_len")) + (F.col("score") - 50) * 0.1)


@query(f"WITH {_LIKE} SELECT frag, ln, round(log_p, 5) AS log_p FROM f")
def fragment_likelihood(spark, d):
    return scored(spark, d).select("frag", "ln", F.round("log_p", 5).alias("log_p"))


@query(f"WITH {_LIKE} SELECT frag, ln, round(p, 5) AS p FROM post")
def fragment_posterior(spark, d):
    return likelihood.posterior(scored(spark, d)).select("frag", "ln", F.round("p", 5).alias("p"))


@query(f"WITH {_LIKE} SELECT fwd, round(sum(p), 3) AS mass FROM post GROUP BY 1")
def strand_mass(spark, d):
    return likelihood.strand_mass(likelihood.posterior(scored(spark, d))).withColumn("mass", F.round("mass", 3))


@query(f"WITH {ALN} SELECT frag FROM aln GROUP BY 1 HAVING max(score) < 20")
def zero_prob_fragments(spark, d):
    a = alignments(spark, d).withColumn("log_p", F.when(F.col("score") >= 20, 0.0).otherwise(float("-inf")))
    return likelihood.impossible_fragments(a)


@query(f"WITH {ALN} SELECT frag, round(ln(sum(exp(score * 0.1))), 6) AS a FROM aln GROUP BY 1")
def log_add_pairs(spark, d):
    """All alignments of every fragment, added pair by pair."""
    x = F.collect_list(F.col("score") * F.lit(0.1))  # a fragment's alignments are few
    a = alignments(spark, d).groupBy("frag").agg(F.reduce(F.array_sort(x), F.lit(float("-inf")), log_add).alias("a"))
    return a.select("frag", F.round("a", 6).alias("a"))


# --- mates

_MATES = f"""{ALN}, l AS (SELECT frag, tid, ln, pos, fwd FROM aln WHERE ln % 2 = 1), r AS (SELECT frag, tid, pos AS mate_pos, fwd AS mate_fwd FROM aln WHERE ln % 2 = 0),
    pairs AS (SELECT frag, tid, pos, mate_pos FROM l JOIN r USING (frag, tid) WHERE fwd <> mate_fwd AND abs(pos - mate_pos) <= 200)"""


def mates(spark, d):
    a = alignments(spark, d).select("frag", "tid", "ln", "pos", "fwd")
    left, right = a.filter("ln % 2 = 1"), a.filter("ln % 2 = 0")
    return left, right, mapping.join_mates(left, right, 200)


@query(f"WITH {_MATES} SELECT * FROM pairs")
def mate_range_join(spark, d):
    return mates(spark, d)[2].select("frag", "tid", "pos", "mate_pos")


_JOINT = f"""{ALN}, l AS (SELECT frag, tid, pos, fwd, score FROM aln WHERE ln % 2 = 1), r AS (SELECT frag, tid, pos AS mate_pos, fwd AS mate_fwd, score FROM aln WHERE ln % 2 = 0),
    pr AS (SELECT frag, tid, 'pair' AS kind, pos, fwd, mate_pos, mate_fwd, l.score + r.score AS score FROM l JOIN r USING (frag, tid) WHERE fwd <> mate_fwd AND abs(pos - mate_pos) <= 200),
    al AS (SELECT * FROM (SELECT frag, tid, 'left' AS kind, pos, fwd, NULL::INTEGER AS mate_pos, NULL::BOOLEAN AS mate_fwd, score FROM l UNION ALL SELECT frag, tid, 'right', NULL, NULL, mate_pos, mate_fwd, score FROM r) ANTI JOIN pr USING (frag)),
    jh AS (SELECT *, 'paired' AS tag FROM pr QUALIFY score >= 0.9 * max(score) OVER (PARTITION BY frag) UNION ALL
        SELECT *, CASE WHEN count(DISTINCT kind) OVER (PARTITION BY frag) = 2 THEN 'apart' ELSE 'only_' || kind END FROM al QUALIFY score >= 0.95 * max(score) OVER (PARTITION BY frag))"""


def joined(spark, d):
    a = alignments(spark, d).select("frag", "tid", "ln", "pos", "fwd", "score")
    return mapping.joint_hits(a.filter("ln % 2 = 1").drop("ln"), a.filter("ln % 2 = 0").drop("ln"), 200)


@query(f"WITH {_JOINT} SELECT * FROM jh")
def joint_hits(spark, d):
    """Pairs near the fragment's best, or single mates near theirs, and what became of the fragment."""
    return joined(spark, d)


@query(f"""WITH {_JOINT} SELECT strand, kind, tag, count(*) AS hits, count(*) FILTER (WHERE CASE WHEN strand = 'U' THEN kind <> 'pair' OR fwd <> mate_fwd WHEN kind = 'pair' THEN fwd = (strand = 'SA') AND mate_fwd <> (strand = 'SA')
    WHEN kind = 'left' THEN fwd = (strand = 'SA') ELSE mate_fwd <> (strand = 'SA') END) AS fitting FROM jh, (VALUES ('U'), ('SA'), ('AS')) s(strand) GROUP BY ALL""")
def library_precheck(spark, d):
    """Joint hits that agree with each kind of library, before they are aligned."""
    one = [F.struct(F.lit(k).alias("strand"), mapping.fits_library(k).alias("ok")) for k in ("U", "SA", "AS")]
    rows = joined(spark, d).select("kind", "tag", F.explode(F.array(*one)).alias("x"))
    return rows.groupBy("x.strand", "kind", "tag").agg(F.count("*").alias("hits"), F.count_if("x.ok").alias("fitting"))


@query(f"WITH {_MATES} SELECT frag, tid, ln FROM l ANTI JOIN pairs USING (frag)")
def orphans_anti(spark, d):
    left, _, pairs = mates(spark, d)
    return mapping.orphans(left, pairs).select("frag", "tid", "ln")


@query(f"""WITH {_MATES}, s AS (SELECT o_orderkey AS frag, EXISTS (SELECT 1 FROM pairs p WHERE p.frag = o_orderkey) AS pr, o_orderkey IN (SELECT frag FROM l) AS lf, o_orderkey IN (SELECT frag FROM r) AS rt,
        coalesce((SELECT bool_and(decoy) FROM aln a WHERE a.frag = o_orderkey), false) AS dc FROM orders)
    SELECT frag, CASE WHEN dc THEN 'd' WHEN pr THEN 'p' WHEN lf AND rt THEN 'm12' WHEN lf THEN 'm1' WHEN rt THEN 'm2' ELSE 'u' END AS code FROM s""")
def unmapped_codes(spark, d):
    pairs = mates(spark, d)[2].groupBy("frag").agg(F.lit(True).alias("pr"))
    a = alignments(spark, d).groupBy("frag").agg(F.bool_or(F.col("ln") % 2 == 1).alias("lf"), F.bool_or(F.col("ln") % 2 == 0).alias("rt"), F.bool_and("decoy").alias("dc"))
    all_ = read(spark, d, "orders").select(F.col("o_orderkey").alias("frag")).join(a, "frag", "left").join(pairs, "frag", "left").na.fill(False)
    return all_.select("frag", mapping.mapping_type(F.col("pr"), F.col("lf"), F.col("rt"), F.col("dc")).alias("code"))


@query(f"""WITH {_MATES}, x AS (SELECT frag, string_agg(tid || ',' || pos, ';' ORDER BY tid, pos) AS lefts FROM l GROUP BY 1), y AS (SELECT frag, string_agg(tid || ',' || mate_pos, ';' ORDER BY tid, mate_pos) AS rights FROM r GROUP BY 1)
    SELECT frag, lefts, rights FROM x JOIN y USING (frag) ANTI JOIN pairs USING (frag)""")
def orphan_links(spark, d):
    left, right, pairs = mates(spark, d)
    text = lambda df, name: df.groupBy("frag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tid", "pos"))), lambda x: F.concat_ws(",", x["tid"].cast("string"), x["pos"].cast("string"))), ";").alias(name))
    return text(left, "lefts").join(text(right, "rights"), "frag").join(pairs.select("frag").distinct(), "frag", "left_anti")


# --- clusters



def all_hits(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("frag"), F.col("l_partkey").alias("tid"))


def components_of(stars):
    return graph.connected_components(graph.class_edges(stars), stars.select("tid"))


_COMPONENTS = """fr AS (SELECT DISTINCT l_orderkey AS frag, l_partkey AS tid FROM lineitem), ed AS (SELECT DISTINCT a.tid AS a, b.tid AS b FROM fr a JOIN fr b USING (frag)),
    lab(it, tid, c) AS (SELECT 0, tid, tid FROM (SELECT DISTINCT tid FROM fr) UNION ALL SELECT it + 1, ed.b, min(c) FROM lab JOIN ed ON ed.a = lab.tid WHERE it < 40 GROUP BY it, ed.b),
    comp AS (SELECT tid, c AS component FROM lab WHERE it = 40)"""


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT tid, component FROM comp")
def connected_components(spark, d):
    return components_of(graph.fragment_stars(all_hits(spark, d)))


def _projected(hits):
    """Masses of the targets, and counts projected by them. All targets of a fragment are in one cluster, so its fragments
    are counted at their least targets."""
    stars = graph.fragment_stars(hits)
    masses = graph.target_masses(stars)
    comp = stored(components_of(stars), "components")
    n = masses.join(comp, "tid").groupBy("component").agg(F.sum("first").alias("n"))
    return masses, graph.projected_counts(masses.select("tid", F.col("total").cast("double").alias("mass")), comp, n)


_PROJECTED = f"""{_COMPONENTS}, m AS (SELECT tid, count(*) AS mass FROM fr GROUP BY 1), k AS (SELECT component, count(DISTINCT frag) AS n FROM fr JOIN comp USING (tid) GROUP BY 1),
    pro AS (SELECT tid, component, n, n * mass / sum(mass) OVER (PARTITION BY component) AS projected FROM m JOIN comp USING (tid) JOIN k USING (component))"""


@query(f"WITH RECURSIVE {_PROJECTED} SELECT tid, round(projected, 5) AS projected FROM pro")
def cluster_projected_counts(spark, d):
    return _projected(all_hits(spark, d))[1].select("tid", F.round("projected", 5).alias("projected"))


@query(f"""WITH RECURSIVE {_PROJECTED}, sz AS (SELECT frag, count(*) AS k FROM fr GROUP BY 1), tc AS (SELECT tid, count(*)::DOUBLE AS high, (count(*) FILTER (WHERE k = 1))::DOUBLE AS low FROM fr JOIN sz USING (frag) GROUP BY 1),
    pp(it, tid, component, n, low, high, x, bound) AS (SELECT 0, tid, component, n::DOUBLE, low, high, projected::DOUBLE, false FROM pro JOIN tc USING (tid) UNION ALL
        SELECT it + 1, tid, component, n, low, high, CASE WHEN abs(fixed + loose - n) <= 1e-9 * greatest(1, n) THEN x WHEN loose = 0 THEN x * n / fixed WHEN bound THEN x ELSE x * (n - fixed) / loose END, bound AND loose <> 0
        FROM (SELECT *, sum(CASE WHEN bound THEN x ELSE 0 END) OVER (PARTITION BY component) AS fixed, sum(CASE WHEN bound THEN 0 ELSE x END) OVER (PARTITION BY component) AS loose
            FROM (SELECT it, tid, component, n, low, high, least(greatest(x, low), high) AS x, bound OR x < low OR x > high AS bound FROM pp WHERE it < 60)))
    SELECT tid, round(x, 6) AS fitted FROM pp WHERE it = 60""")
def polytope_projection(spark, d):
    masses, projected = _projected(all_hits(spark, d))
    rows = projected.join(masses, "tid")
    return graph.project_to_bounds(rows.select("component", F.col("tid").cast("long").alias("tid"), "projected", "uniq", "total", "n")).withColumn("fitted", F.round("fitted", 6))


# --- sequences

_REV = "translate(reverse(seq), 'ACGT', 'TGCA')"


@query(f"WITH {SEQS} SELECT tid, {_REV} AS rc FROM seqs")
def revcomp(spark, d):
    return sequences(spark, d).select("tid", seq.reverse_complement(F.col("seq")).alias("rc"))


_K = 15


_SEQ_KMERS = "SELECT substr(seq, CAST(i + 1 AS BIGINT), {0}) AS kmer, tid, CAST(i AS INTEGER) AS pos FROM (SELECT tid, seq, unnest(range(length(seq) - {0} + 1)) AS i FROM seqs WHERE length(seq) >= {0})"


@query(f"WITH {SEQS}, idx AS ({_SEQ_KMERS.format(_K)}) SELECT least(kmer, translate(reverse(kmer), 'ACGT', 'TGCA')) AS kmer, count(*) AS n, count(DISTINCT tid) AS targets FROM idx GROUP BY 1")
def kmer_index(spark, d):
    rows = kmers.kmer_counts(sequences(spark, d), _K)
    return rows.select(seq.kmer_text(F.col("kmer"), _K).alias("kmer"), "n", "targets")


@query(f"WITH {SEQS}, idx AS ({_SEQ_KMERS.format(6)}) SELECT kmer, count(*) AS n FROM idx GROUP BY 1")
def kmer_histogram(spark, d):
    return bias.kmer_histogram(sequences(spark, d))


@query(f"""WITH {SEQS}, idx AS ({_SEQ_KMERS.format(6)}) SELECT kmer, CAST(list_sum(list_transform(range(1, 7), lambda i: (strpos('ACGT', substr(kmer, CAST(i AS BIGINT), 1)) - 1) * CAST(pow(4, 6 - i) AS BIGINT))) AS BIGINT) AS code FROM (SELECT DISTINCT kmer FROM idx)""")
def kmer_codes(spark, d):
    k = kmer_histogram(spark, d).select("kmer")
    return k.withColumn("code", seq.kmer_code(F.col("kmer"))).filter(seq.kmer_text(F.col("code"), 6) == F.col("kmer"))


def reads(spark, d):
    return read(spark, d, "pages").select(F.col("page_id").alias("frag"), seq.clean(F.col("html")).alias("seq"))


_READS = "reads AS (SELECT page_id AS frag, upper(regexp_replace(html, '[^acgtACGT]', '', 'g')) AS seq FROM pages)"
_SEED_K = _K
_HITS = f"""{SEQS}, {_READS}, idx AS ({_SEQ_KMERS.format(_SEED_K)}),
    rk AS (SELECT substr(seq, CAST(i + 1 AS BIGINT), {_SEED_K}) AS kmer, frag, CAST(i AS INTEGER) AS rpos FROM (SELECT frag, seq, unnest(range(length(seq) - {_SEED_K} + 1)) AS i FROM reads WHERE length(seq) >= {_SEED_K})),
    rare AS (SELECT kmer FROM idx GROUP BY 1 HAVING count(*) <= 1000), sh AS (SELECT frag, rpos, tid, pos FROM rk JOIN idx USING (kmer) SEMI JOIN rare USING (kmer))"""


def of_seeds(spark, d, then, fields):
    """What ``then`` makes of the pages' seeds on texts, page by page."""
    return cells.of_cells(reads(spark, d), sequences(spark, d), _SEED_K, then, fields)


def of_stranded(reads_, targets_, then, fields):
    return cells.of_cells(reads_, targets_, _SEED_K, then, fields, stranded=True)


def most_hits(found):
    """Rows (frag, hits, and others) with as many hits as any of the frag."""
    return found.withColumn("__t", F.max("hits").over(Window.partitionBy("frag"))).filter("hits = __t").drop("__t")


@query(f"WITH {_HITS} SELECT frag, tid, count(*) AS n FROM sh GROUP BY 1, 2")
def seed_join(spark, d):
    return of_seeds(spark, d, cells.pair_counts, "n long")


@query(f"WITH {_HITS} SELECT frag, tid, pos - rpos AS diagonal, count(*) AS seeds, min(rpos) AS first, max(rpos) AS last FROM sh GROUP BY 1, 2, 3")
def seed_chains(spark, d):
    return of_seeds(spark, d, cells.diagonals, "diagonal int, seeds long, first int, last int")


@query(f"WITH {_HITS}, h AS (SELECT frag, tid, count(DISTINCT rpos) AS hits FROM sh GROUP BY 1, 2) SELECT frag, tid, hits FROM h QUALIFY hits = max(hits) OVER (PARTITION BY frag)")
def sketch_map(spark, d):
    return most_hits(of_seeds(spark, d, cells.most_kmers, "hits long"))


_CHAINS = f"""{_HITS},
    g AS (SELECT *, pos - rpos AS dg, rpos - lag(rpos) OVER w AS gap FROM sh WINDOW w AS (PARTITION BY frag, tid, pos - rpos ORDER BY rpos)),
    rn AS (SELECT *, sum(CASE WHEN gap <= 500 THEN 0 ELSE 1 END) OVER (PARTITION BY frag, tid, dg ORDER BY rpos) AS run FROM g),
    runs AS (SELECT frag, tid, dg, run, count(*) AS seeds, sum(least(coalesce(gap, {_SEED_K}), {_SEED_K})) AS bases, min(rpos) AS first, max(rpos) + {_SEED_K} AS last FROM rn GROUP BY ALL),
    pv AS (SELECT *, lag(dg) OVER w AS pd, lag(first) OVER w AS pf, lag(last) OVER w AS pl FROM runs WINDOW w AS (PARTITION BY frag, tid ORDER BY first + dg, first)),
    nw AS (SELECT *, CASE WHEN pf IS NULL OR abs(dg - pd) > 15 OR first <= pf OR last + dg - pf - pd > 500 THEN 1 ELSE 0 END AS new FROM pv),
    ch AS (SELECT *, sum(new) OVER (PARTITION BY frag, tid ORDER BY first + dg, first) AS chain FROM nw),
    gc AS (SELECT frag, tid, CAST(chain AS BIGINT) AS chain, CAST(sum(seeds) AS BIGINT) AS seeds, CAST(sum(bases - CASE WHEN new = 1 THEN 0 ELSE least(greatest(pl - first, 0), bases) END) AS BIGINT) AS bases, min(first) AS first, max(last) AS last, min(first + dg) AS start, max(last + dg) AS stop FROM ch GROUP BY ALL)"""


def gapped(spark, d, share=None):
    return of_seeds(spark, d, cells.gapped_chains(_SEED_K, 500, share=share), "chain long, seeds long, bases long, first int, last int, start int, stop int")


def consensus(spark, d):
    return mapping.consensus_filter(gapped(spark, d, share=0.65), share=0.65)


@query(f"WITH {_CHAINS} SELECT frag, tid, chain, seeds, bases, first, last, start, stop FROM gc")
def gapped_chains(spark, d):
    return gapped(spark, d)


@query(f"""WITH {_CHAINS}, f1 AS (SELECT * FROM gc QUALIFY bases >= 0.65 * max(bases) OVER (PARTITION BY frag)) SELECT frag, tid, chain, bases FROM f1 QUALIFY bases >= 0.75 * max(bases) OVER (PARTITION BY frag, tid)""")
def consensus_chains(spark, d):
    return consensus(spark, d).select("frag", "tid", "chain", "bases")


@query(f"""WITH {SEQS}, {_READS}, idx AS ({_SEQ_KMERS.format(_SEED_K)}), can AS (SELECT *, least(kmer, {_REV.replace('seq', 'kmer')}) AS c FROM idx),
    rare AS (SELECT c FROM can GROUP BY 1 HAVING count(*) <= 1000), way AS (SELECT frag, seq, true AS fwd FROM reads UNION ALL SELECT frag, {_REV}, false FROM reads),
    rk AS (SELECT substr(seq, CAST(i + 1 AS BIGINT), {_SEED_K}) AS kmer, frag, fwd, i AS rpos FROM (SELECT frag, fwd, seq, unnest(range(length(seq) - {_SEED_K} + 1)) AS i FROM way WHERE length(seq) >= {_SEED_K})),
    one AS (SELECT frag, tid, fwd, rpos, min(pos) AS pos FROM rk JOIN can USING (kmer) SEMI JOIN rare USING (c) GROUP BY ALL),
    up AS (SELECT * FROM one QUALIFY coalesce(pos > max(pos) OVER (PARTITION BY frag, tid, fwd ORDER BY rpos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)),
    n AS (SELECT frag, tid, fwd, count(*) AS hits FROM up GROUP BY ALL HAVING max(pos) - min(pos) <= (max(rpos) - min(rpos)) * 1.25 + {_SEED_K})
    SELECT frag, tid, fwd, hits FROM n QUALIFY hits = max(hits) OVER (PARTITION BY frag)""")
def sketch_strands(spark, d):
    return most_hits(of_stranded(reads(spark, d), sequences(spark, d), cells.rising_kmers(_SEED_K), "fwd boolean, hits long"))


def collinear(reads_, targets_, least_bases=0):
    fields = "fwd boolean, score long, seeds long, bases long, first long, last long, start long, stop long"
    return of_stranded(reads_, targets_, cells.collinear_chains(_SEED_K, 500, least_bases=least_bases), fields)


@query()
def collinear_chains(spark, d):
    """The best chains of pages on texts, on both strands."""
    return collinear(reads(spark, d), sequences(spark, d))


def short_reads(spark, d):
    """(frag, seq): the pages in pieces of 100 letters."""
    r = reads(spark, d).filter(F.length("seq") > 0)
    i = F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / 100).cast("int"))).alias("i")
    return r.select("frag", "seq", i).select((F.col("frag") * 65536 + F.col("i")).alias("frag"), F.substring("seq", F.col("i") * 100 + 1, F.lit(100)).alias("seq"))


def short_chains(spark, d):
    return mapping.consensus_filter(collinear(short_reads(spark, d), sequences(spark, d), 31))  # a seed of the usual 31 letters


@query()
def score_chains(spark, d):
    """Scores of pieces of pages where their chains put them, of 0.65 of a perfect score and more."""
    chains = stored(short_chains(spark, d), "chains")  # read twice: by parts of a block, and by longer ones
    return mapping.score_chains(chains, short_reads(spark, d), sequences(spark, d))


@query()
def rescued_mates(spark, d):
    """The first half of a piece of a page is a read; the other half, on the other strand and with every twelfth letter
    overwritten, its mate, which shares no seed with any target: mates found near their reads, with 6 edits at most."""
    r = short_reads(spark, d).filter(F.length("seq") == 100)
    left = r.select("frag", F.substring("seq", 1, 50).alias("seq"))
    worn = F.regexp_replace(F.substring("seq", 51, 50), "(.{11}).", "$1A")
    right = r.select("frag", seq.reverse_complement(worn).alias("seq"))
    t = sequences(spark, d)
    anchors = stored(collinear(left, t, 31), "anchors")
    right = right.join(anchors.select("frag").distinct(), "frag", "left_semi")  # only mates of anchors are asked for
    # where there is a seed there is a chain; only pairs of anchors are asked for
    others = cells.of_cells(right, t, _SEED_K, cells.pair_counts, "n long", stranded=True, asked=anchors.select("frag", "tid").distinct())
    return mapping.rescue(mapping.missing_mates(anchors, others, right, t, 200), 6)


@query(f"WITH {_READS} SELECT count(*) AS reads, min(length(seq)) AS shortest, count(*) FILTER (WHERE length(seq) < {_K}) AS too_short, count(*) > 0 AND count(*) = count(*) FILTER (WHERE length(seq) < {_K}) AS all_too_short FROM reads")
def read_statistics(spark, d):
    return mapping.read_statistics(reads(spark, d), _K).withColumn("shortest", F.col("shortest").cast("long"))


@query(f"WITH {SEQS} SELECT min(tid) AS tid, length(seq) AS len FROM seqs GROUP BY seq")
def dedup_targets(spark, d):
    return mapping.distinct_targets(sequences(spark, d)).select("tid", F.length("seq").cast("long").alias("len"))


@query(f"WITH {SEQS} SELECT tid, length(regexp_replace(seq, 'A{{2,}}$', '')) AS len FROM seqs")
def polya_clip(spark, d):
    return sequences(spark, d).select("tid", F.length(seq.clip_poly_a(F.col("seq"), 2)).cast("long").alias("len"))


_GC = "CAST(round_even(100.0 * length(regexp_replace({0}, '[AT]', '', 'g')) / nullif(length({0}), 0), 0) AS INTEGER)"


@query(f"WITH {SEQS} SELECT tid, {_GC.format('seq')} AS gc FROM seqs WHERE length(seq) > 0")
def gc_fraction(spark, d):
    return sequences(spark, d).filter(F.length("seq") > 0).select("tid", seq.gc_percent(F.col("seq"), F.lit(0), F.length("seq")).alias("gc"))


_CTX = "(substr(seq, CAST(p - 2 AS BIGINT), 5) || substr(seq, CAST(p + 50 AS BIGINT), 5))"


def places(spark, d, length):
    """(tid, seq, p): fragments one after the other along each sequence, of which ``length`` letters must be there."""
    return sequences(spark, d).select("tid", "seq", F.explode(seq.starts(F.col("seq"), 10, length, 50)).alias("p"))


@query(f"WITH {SEQS}, pl AS (SELECT tid, seq, unnest(range(10, length(seq) - 59, 50)) AS p FROM seqs) SELECT tid, p, {_GC.format(_CTX)} AS gc FROM pl")
def gc_context(spark, d):
    s = places(spark, d, 60)
    return s.select("tid", F.col("p").cast("long").alias("p"), seq.context_gc_percent(F.col("seq"), F.col("p"), F.lit(51)).alias("gc"))


_GCBIN = f"""{SEQS}, g AS (SELECT tid, tid % 3 AS ctx, {_GC.format('substr(seq, CAST(p + 1 AS BIGINT), 50)')} AS gc FROM (SELECT tid, seq, unnest(range(10, length(seq) - 49, 50)) AS p FROM seqs)),
    b AS (SELECT tid, ctx, CAST(least(24, floor(gc / 4.0)) AS INTEGER) AS gc FROM g)"""


def gc_observations(spark, d):
    s = places(spark, d, 50)
    return s.select("tid", (F.col("tid") % 3).alias("ctx"), seq.percent_bin(seq.gc_percent(F.col("seq"), F.col("p"), F.lit(50)), 25).alias("gc"), F.lit(1.0).alias("w"))


@query(f"WITH {_GCBIN} SELECT gc, count(*) AS n FROM b GROUP BY 1")
def gc_bins(spark, d):
    return gc_observations(spark, d).groupBy("gc").agg(F.count("*").alias("n"))


_CELLS = """(SELECT ctx, gc, (w + 0.1) / sum(w + 0.1) OVER (PARTITION BY ctx) AS p FROM (SELECT c.ctx, CAST(e.i AS INTEGER) AS gc, (SELECT count(*) FROM b WHERE b.ctx = c.ctx AND b.gc = e.i AND {0}) AS w FROM (SELECT DISTINCT ctx FROM b WHERE {0}) c, range(25) e(i)))"""


@query(f"WITH {_GCBIN} SELECT o.ctx, o.gc, round(least(1000, greatest(0.001, o.p / x.p)), 6) AS ratio FROM {_CELLS.format('b.tid % 2 = 0')} o JOIN {_CELLS.format('b.tid % 2 = 1')} x USING (ctx, gc)")
def gc_ratio(spark, d):
    o = gc_observations(spark, d)
    return bias.gc_ratio(bias.gc_model(o.filter("tid % 2 = 0")), bias.gc_model(o.filter("tid % 2 = 1"))).withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH {ALN} SELECT CAST(tid % 5 AS INTEGER) AS length_class, CAST(least(19, floor(pos * 20 / len::DOUBLE)) AS INTEGER) AS bin, CAST(count(*) AS DOUBLE) AS mass FROM aln GROUP BY 1, 2""")
def pos_bias_bins(spark, d):
    a = alignments(spark, d).select((F.col("tid") % 5).alias("length_class"), "pos", "len", F.lit(1.0).alias("w"))
    return bias.position_model(a).select("length_class", "bin", "mass")


@query(f"""WITH {SEQS} SELECT CAST(pos AS INTEGER) AS pos, substr(w, CAST(pos - o + 1 AS BIGINT), CAST(o AS BIGINT)) AS ctx, substr(w, CAST(pos + 1 AS BIGINT), 1) AS base, CAST(count(*) AS DOUBLE) AS n
    FROM (SELECT substr(seq, CAST(i + 1 AS BIGINT), 9) AS w FROM (SELECT seq, unnest(range(length(seq) - 8)) AS i FROM seqs WHERE length(seq) >= 9)), (SELECT i AS pos, least(i, 2) AS o FROM range(9) t(i)) GROUP BY 1, 2, 3""")
def markov_counts(spark, d):
    return bias.markov_counts(nine_letters(spark, d))


def nine_letters(spark, d):
    """(seq, w): every window of nine letters, with how often it occurs."""
    n = kmers.kmer_counts(sequences(spark, d), 9, both_strands=False)
    return n.select(seq.kmer_text(F.col("kmer"), 9).alias("seq"), F.col("n").cast("double").alias("w"))


@query("SELECT l_orderkey AS frag, l_linenumber AS ln, 2 * CAST(l_quantity AS INTEGER) + CAST(l_partkey % 7 + 1 AS INTEGER) AS ref_span, CAST(l_linenumber + 2 * CAST(l_quantity AS INTEGER) + l_suppkey % 5 + 1 AS INTEGER) AS read_span FROM lineitem")
def cigar_ops(spark, d):
    line = read(spark, d, "lineitem")
    q = F.col("l_quantity").cast("int").cast("string")
    cigar = F.concat(F.col("l_linenumber").cast("string"), F.lit("S"), q, F.lit("M"), (F.col("l_partkey") % 7 + 1).cast("string"), F.lit("D"), (F.col("l_suppkey") % 5 + 1).cast("string"), F.lit("I"), q, F.lit("="))
    return line.select(F.col("l_orderkey").alias("frag"), F.col("l_linenumber").alias("ln"), seq.cigar_length(cigar, "MDN=X").alias("ref_span"), seq.cigar_length(cigar, "MIS=X").alias("read_span"))


# --- streams and samples


@query("""SELECT batch, round(sum(CASE WHEN batch > 1 THEN 0.65 * ln(greatest(batch - 1, 1)) - ln(nullif(pow(batch, 0.65) - 1, 0)) ELSE 0 END) OVER (ORDER BY batch), 6) AS log_mass
    FROM (SELECT DISTINCT CAST(event_id // 500 + 1 AS INTEGER) AS batch FROM events)""")
def forgetting_mass(spark, d):
    b = read(spark, d, "events").select(F.floor(F.col("event_id") / 500 + 1).cast("int").alias("batch")).distinct()
    return inference.forgetting_mass(b).select("batch", F.round("log_mass", 6).alias("log_mass"))


@query("""WITH i AS (SELECT i::DOUBLE AS i FROM range(1, (SELECT max(event_id // 500) + 2 FROM events)) t(i)),
    lm AS (SELECT i AS batch, sum(CASE WHEN i > 1 THEN 0.65 * ln(greatest(i - 1, 1)) - ln(nullif(pow(i, 0.65) - 1, 0)) ELSE 0 END) OVER (ORDER BY i) AS log_mass FROM i)
    SELECT CAST(user_id % 25 AS INTEGER) AS tid, round(sum(exp(log_mass)), 4) AS mass FROM events JOIN lm ON batch = event_id // 500 + 1 GROUP BY 1""")
def online_pass(spark, d):
    from ..streaming.online import online_masses

    rows = read(spark, d, "events").select((F.floor((F.col("event_id") / 500)) + 1).cast("int").alias("batch"), "event_id", (F.col("user_id") % 25).cast("int").alias("tid"))
    return online_masses(rows).withColumn("mass", F.round("mass", 4))


@query()
def one_pass_masses(spark, d):
    """Line items as alignments of their orders, in batches of 20,000 order keys; lengths count after 2,000 fragments and
    are settled after 10,000."""
    from ..streaming.one_pass import PassRules, whole_pass

    a = alignments(spark, d).select((F.col("frag") / 20_000).cast("int").alias("batch"), "frag", "tid", F.exp(F.col("score") * 0.1).alias("w"), (50 + F.col("score") * 10).alias("frag_len"))
    run, last = whole_pass(a, targets(spark, d), PassRules(before_lengths=2_000, burn_in=10_000))
    return run.masses(last)


@query()
def bootstrap(spark, d):
    return inference.bootstrap(equal_members(spark, d), draws=4, rounds=10)


@query()
def posterior_draws(spark, d):
    """Gibbs draws with weights and effective lengths, from abundances by expectation maximisation, as numbers of fragments."""
    m = class_weights(spark, d)
    t = target_lengths(spark, d)
    begin = inference.expectation_maximisation(classes.length_weights(m, t), ROUNDS)
    return inference.posterior_draws(m, 4, t, begin, thinning=4)


@query()
def gibbs(spark, d):
    return inference.gibbs(equal_members(spark, d), chains=2, kept_draws=2, thinning=2)


@query(f"""WITH {_LIKE}, q AS (SELECT frag, tid, sum(p) AS p FROM post GROUP BY 1, 2), cu AS (SELECT *, sum(p) OVER (PARTITION BY frag ORDER BY tid) AS cum, max(tid) OVER (PARTITION BY frag) AS top,
        (CAST('0x' || substr(md5(CAST(frag AS VARCHAR) || ':1'), 1, 8) AS BIGINT)::DOUBLE + 0.5) / 4294967296 AS u FROM q)
    SELECT frag, tid, round(p, 6) AS p FROM cu WHERE cum > u OR tid = top QUALIFY row_number() OVER (PARTITION BY frag ORDER BY tid) = 1""")
def posterior_sample(spark, d):
    p = likelihood.posterior(scored(spark, d)).groupBy("frag", "tid").agg(F.sum("p").alias("p"))
    return inference.posterior_sample(p).withColumn("p", F.round("p", 6))


def bias_tables(spark, d):
    """Fragments (chains of pages on texts) and targets, with uncorrected lengths and length classes."""
    seqs = sequences(spark, d).filter(F.length("seq") > 0).withColumn("len", F.length("seq"))
    share = np.array([p for _, p in lengths.truncated_normal(120.0, 20.0, 300)])
    cmf, mean = np.cumsum(share), np.cumsum(share * np.arange(301))
    known = F.array(*(F.lit(float(m / c) if c > 0 else 0.0) for m, c in zip(mean, cmf, strict=True)))
    eff = F.col("len") - known[F.least("len", F.lit(300))]
    chains = stored(consensus(spark, d), "chains").withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("frag")))
    t = lengths.length_classes(seqs).withColumn("eff_len", F.when(eff < 1, F.col("len").cast("double")).otherwise(eff))
    t = t.join(chains.groupBy("tid").agg(F.sum("w").alias("alpha")), "tid", "left").na.fill(0.0, ["alpha"])
    t = stored(t.repartition(4 * spark.sparkContext.defaultParallelism, "tid"), "bias-targets")  # few bytes, but work for all cores
    low, high = int(np.searchsorted(cmf, 0.005)), int(np.searchsorted(cmf, 0.995))
    return chains.select("frag", "tid", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "w"), t, cmf, low, high


@query()
def quant_with_bias(spark, d):
    """Abundances from pages on texts, with lengths corrected once in mid run by what the abundances then say; texts whose
    number ends in 7 are auxiliary. Observed models come from one chain of each page."""
    chains, t, cmf, low, high = bias_tables(spark, d)
    t = t.drop("alpha").withColumn("auxiliary", F.col("tid") % 10 == 7)
    hits = chains.groupBy("frag", "tid").agg(F.sum("w").alias("w"))
    labelled = classes.labels(hits)
    members = stored(classes.weights(hits, labelled).join(classes.counts(labelled), "key"), "bias-run-classes")
    observed = stored(bias.observed_models(bias.bias_sample(chains), t), "bias-observed")

    def correct(alpha):
        rows = t.join(alpha, "tid", "left").na.fill(0.0, ["alpha"])
        if not bias.enough_background(rows):
            return None
        models = bias.models_of(observed, bias.expected_models(rows, cmf, low, high))
        return bias.corrected_lengths(t, models, cmf, low, high)

    run = inference.BiasRun(members, t.select("tid", "eff_len"), correct, least_rounds=20, tolerance=0.05)
    return run.run().join(run.lengths(), "tid")


@query()
def bias_models(spark, d):
    chains, t, cmf, low, high = bias_tables(spark, d)
    o = bias.observed_models(chains, t).withColumn("kind", F.lit("observed"))
    return o.unionByName(bias.expected_models(t, cmf, low, high).withColumn("kind", F.lit("expected")))


@query()
def mutation_rate(spark, d):
    """All texts' letters mutated at a rate of 0.02, and how far they then differ."""
    from ..operators import mutation

    t = sequences(spark, d)
    return mutation.difference_rate(t, mutation.mutate(t, 0.02))


@query()
def bias_corrected_length(spark, d):
    """Sequence, G+C and place at once."""
    chains, t, cmf, low, high = bias_tables(spark, d)
    models = bias.models_of(bias.observed_models(chains, t), bias.expected_models(t, cmf, low, high))
    return bias.corrected_lengths(t, models, cmf, low, high)


@query("""WITH b AS (SELECT l_orderkey AS frag, CAST(l_linenumber // 2 AS INTEGER) AS bin, l_returnflag AS cur, coalesce(lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey), '-') AS prev FROM lineitem)
    SELECT bin, prev, cur, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY bin, prev) AS DOUBLE), 6) AS p FROM b GROUP BY 1, 2, 3""")
def error_model(spark, d):
    line = read(spark, d, "lineitem")
    prev = F.lag("l_returnflag").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = line.select(F.floor(F.col("l_linenumber") / 2).cast("int").alias("bin"), F.coalesce(prev, F.lit("-")).alias("prev"), F.col("l_returnflag").alias("cur"), F.lit(1.0).alias("mass"))
    return likelihood.error_rates(rows).withColumn("p", F.round("p", 6))


_LETTERS = f"""{CIGARS}, sy AS (SELECT *, unnest(range(ln + 2 * q + d + i)) AS s FROM ca),
    op AS (SELECT *, CASE WHEN s < ln THEN 'S' WHEN s < ln + q THEN 'M' WHEN s < ln + q + d THEN 'D' WHEN s < ln + q + d + i THEN 'I' ELSE 'N' END AS op,
        s IN (0, ln, ln + q, ln + q + d, ln + q + d + i) AS opens, ln + 2 * q + i AS size, s - CASE WHEN s < ln + q + d THEN 0 ELSE d END AS rp, s - ln - CASE WHEN s < ln + q + d THEN 0 ELSE i END AS tp FROM sy),
    st AS (SELECT rid, frag, ln, side, w, s, CAST(max(CASE WHEN opens OR op = 'D' THEN 0 ELSE rp * 6 // size END) OVER (PARTITION BY rid ORDER BY s) AS INTEGER) AS bin,
        CAST(9 * CASE WHEN op = 'S' THEN 5 WHEN op = 'I' THEN 4 ELSE strpos('ACGT', substr(ref, tp + 1, 1)) - 1 END + CASE WHEN op = 'D' THEN 4 ELSE strpos('ACGT', substr(read, rp + 1, 1)) - 1 END AS INTEGER) AS cur FROM op),
    tr AS (SELECT *, lag(cur, 1, 81) OVER (PARTITION BY rid ORDER BY s) AS prev FROM st), ms AS (SELECT side, bin, prev, cur, sum(w) AS mass FROM tr GROUP BY ALL)"""


@query(f"WITH {_LETTERS} SELECT side, bin, prev, cur, round(mass, 4) AS mass FROM ms")
def error_transitions(spark, d):
    return errors.transition_masses(cigar_alignments(spark, d)).withColumn("mass", F.round("mass", 4))


@query(f"""WITH {_LETTERS}, sums AS (SELECT side, bin, prev, sum(mass) + 82 AS total FROM ms GROUP BY ALL), zero AS (SELECT side, bin, coalesce(max(mass) FILTER (WHERE prev = 0 AND cur = 0), 0) + 1 AS m, coalesce(sum(mass) FILTER (WHERE prev = 0), 0) + 82 AS t FROM ms GROUP BY ALL)
    SELECT frag, ln, round(sum(ln((mass + 1) / total) - ln(m / t)), 4) AS log_err FROM tr JOIN ms USING (side, bin, prev, cur) JOIN sums USING (side, bin, prev) JOIN zero USING (side, bin) GROUP BY rid, 1, 2""")
def error_likelihoods(spark, d):
    """Of all alignments, by the rates that their own weighted letters give."""
    a = stored(cigar_alignments(spark, d).select("frag", "ln", "side", "w", "cigar", "read", "ref"), "cigar-alignments")  # read twice
    rates = errors.log_rates(errors.transition_masses(a))
    return errors.log_error(a, rates, ["frag", "ln"]).withColumn("log_err", F.round("log_err", 4))


_COUNTED = f"""{_LETTERS}, ct AS (SELECT frag, ln, any_value(w) AS w, any_value(size) AS size, count(*) FILTER (WHERE op = 'S') AS front, count(*) FILTER (WHERE op IN ('I', 'D') OR (op IN ('M', 'N') AND substr(ref, tp + 1, 1) <> substr(read, rp + 1, 1))) AS errors FROM op GROUP BY rid, 1, 2),
    ln_ AS (SELECT *, size - front AS n, CAST(least(500, (size - front) // 20) AS INTEGER) AS eb, CAST(least(500, size // 20) AS INTEGER) AS cb FROM ct),
    er AS (SELECT eb, sum(w * errors / n) / sum(w) AS rate, sum(w) AS mass FROM ln_ WHERE n > 0 AND errors <= n GROUP BY 1), fr AS (SELECT cb, sum(w * front / size * (cb + 1) * 20) / sum(w) AS mean, sum(w) AS mass FROM ln_ WHERE n > 0 AND errors <= n GROUP BY 1)"""


def counted_letters(spark, d):
    return errors.error_counts(cigar_alignments(spark, d), ["frag", "ln", "w"])


@query(f"WITH {_COUNTED} SELECT 'error' AS kind, eb AS bin, round(mass, 4) AS mass, round(rate, 6) AS mean FROM er UNION ALL SELECT 'front', cb, round(mass, 4), round(mean, 6) FROM fr UNION ALL SELECT 'back', cb, round(mass, 4), 0.0 FROM fr")
def long_read_rates(spark, d):
    """Rates by length, in bins of 20 letters, as the table's reads are short."""
    return errors.long_read_rates(counted_letters(spark, d), 20).withColumns({c: F.round(c, k) for c, k in (("mass", 4), ("mean", 6))})


@query(f"""WITH {_COUNTED}, ks AS (SELECT DISTINCT n, rate FROM ln_ JOIN er USING (eb)),
    pm AS (SELECT n, rate, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(rate) + (n - k) * ln(1 - rate)) AS pk FROM (SELECT *, unnest(range(n + 1)) AS k FROM ks)),
    cd AS (SELECT n, rate, k, sum(pk) OVER (PARTITION BY n, rate ORDER BY k) AS c FROM pm), md AS (SELECT n, rate, min(k) AS med FROM cd WHERE c >= 0.5 GROUP BY 1, 2),
    ev AS (SELECT frag, ln, front, mean, n, rate, greatest(med - abs(med - errors), 0) AS lo, least(med + abs(med - errors), n) AS hi FROM ln_ JOIN er USING (eb) JOIN fr USING (cb) JOIN md USING (n, rate))
    SELECT frag, ln, round(ln(a.c + 1 - b.c) + CASE WHEN front > round(mean) THEN (front - round(mean)) * ln(mean / (mean + 1)) ELSE 0 END, 4) + 0.0 AS log_err
    FROM ev JOIN cd a ON a.n = ev.n AND a.rate = ev.rate AND a.k = lo JOIN cd b ON b.n = ev.n AND b.rate = ev.rate AND b.k = hi""")
def long_read_likelihoods(spark, d):
    c = stored(counted_letters(spark, d), "counted-letters")  # read twice, expanded once
    return errors.long_read_log(c, errors.long_read_rates(c, 20), 20).select("frag", "ln", F.round("log_err", 4).alias("log_err"))
