"""Result tables as files. Large results stay in as many parts as Spark has; only single lines are made on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classes
from ..operators.ranks import running_sum
from ..store import stored

_TITLES = {"name": "Name", "length": "Length", "effective_length": "EffectiveLength", "tpm": "TPM", "num_reads": "NumReads", "unique_count": "UniqueCount", "ambig_count": "AmbigCount"}


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated, with the usual titles."""
    df.select(*(F.col(c).alias(_TITLES.get(c, c)) for c in df.columns)).write.csv(path, sep="\t", header=True, nullValue="NA")


def write_classes(counts: DataFrame, targets: DataFrame, path: str, weights: DataFrame | None = None) -> None:
    """Classes (key, n) as text in two tables below ``path``: targets in order, and for each class size, targets,
    weights if given (key, tid, w), count."""
    targets.orderBy("tid").select("name").write.text(f"{path}/targets")
    ordinals = running_sum(targets.select("tid"), "tid", F.lit(1), "at").select("tid", (F.col("at") - 1).cast("string").alias("at"))
    own = classes.members(counts.select("key", "n")).join(ordinals, "tid").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("tid", "at"))), lambda x: x["at"]).alias("tids"))
    rows = counts.join(own, "key")
    parts = [F.size("tids").cast("string"), F.array_join("tids", "\t")]
    if weights is not None:
        w = weights.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tid", "w"))), lambda x: x["w"].cast("string")), "\t").alias("ws"))
        rows, parts = rows.join(w, "key"), [*parts, F.col("ws")]
    rows.select(F.concat_ws("\t", *parts, F.col("n").cast("string")).alias("value")).write.text(f"{path}/classes")


def write_class_file(counts: DataFrame, targets: DataFrame, path: str, weights: DataFrame | None = None, lengths: DataFrame | None = None) -> None:
    """Classes (key, n) of targets (tid, name) as one list of lines, in parts whose names follow their order: the number of
    targets, of classes, the names, then for each class size, targets by their ordinal, weights if given (key, tid, w) and
    count, and at last names with effective lengths, if given (tid, eff_len). tids may be any numbers."""
    spark = counts.sparkSession
    first = stored(running_sum(targets.select("tid", "name"), "tid", F.lit(1), "at").select("tid", "name", (F.col("at") - 1).alias("at")), "class-file-targets")
    each = classes.members(counts.select("key", "n")).join(first.select("tid", "at"), "tid")
    each = each.join(weights.select("key", "tid", "w"), ["key", "tid"]) if weights is not None else each.withColumn("w", F.lit(None).cast("double"))
    one = F.array_sort(F.collect_list(F.struct("at", "w")))  # of one class
    lists = each.groupBy("key", "n").agg(one.alias("m"))
    text = lambda c: F.array_join(F.transform("m", lambda x: x[c].cast("string")), "\t")
    parts = [F.size("m").cast("string"), text("at"), *([text("w")] if weights is not None else []), F.col("n").cast("string")]
    rows = stored(lists.select("key", F.concat_ws("\t", *parts).alias("value")), "class-file-rows")
    head = spark.createDataFrame([(0, 0, "", str(first.count())), (0, 1, "", str(rows.count()))], "section int, place long, key string, value string")
    section = lambda n, place, key, value: (F.lit(n).alias("section"), place.cast("long").alias("place"), key.alias("key"), value.alias("value"))
    lines = head.unionByName(first.select(*section(1, F.col("at"), F.lit(""), F.col("name")))).unionByName(rows.select(*section(2, F.lit(0), F.col("key"), F.col("value"))))
    if lengths is not None:
        known = first.join(lengths.select("tid", "eff_len"), "tid")
        lines = lines.unionByName(known.select(*section(3, F.col("at"), F.lit(""), F.concat_ws("\t", "name", F.col("eff_len").cast("string")))))
    lines.orderBy("section", "place", "key").select("value").write.text(path)


def length_sample(dist: DataFrame, draws: int = 10_000, seed: int = 1) -> DataFrame:
    """(length, n): how often each length of a distribution (length from 0 on, c) comes up in some draws; a draw is the
    first length whose running share exceeds a hash of its number."""
    shares = dist.agg(F.transform(F.array_sort(F.collect_list(F.struct("length", "c"))), lambda x: x["c"]).alias("cs"))  # a thousand numbers
    digest = F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))).cast("binary")), 1, 8)
    u = (F.conv(digest, 16, 10).cast("double") + 0.5) / float(1 << 32)
    drawn = dist.sparkSession.range(draws).withColumn("u", u).crossJoin(F.broadcast(shares))  # one row on the right
    length = F.least(F.size(F.filter("cs", lambda c: c <= F.col("u"))), F.size("cs") - 1)
    return drawn.groupBy(length.cast("int").alias("length")).agg(F.count("*").alias("n"))


def write_bias_models(models: DataFrame, path: str) -> None:
    """Cells (kind, model, a, b, mass) of observed and expected models, a folder for each; cells with no mass are left out."""
    models.filter("mass != 0").select("kind", "model", "a", "b", F.col("mass").cast("double").alias("mass")).repartition("kind", "model").write.partitionBy("kind", "model").parquet(path)


#: Facts of a run, by name, with the value each has where there is nothing to tell.
FACTS = {
    "samp_type": "none", "opt_type": "em", "quant_errors": [], "num_libraries": 0, "library_types": [], "frag_dist_length": 0, "frag_length_mean": 0.0, "frag_length_sd": 0.0,
    "seq_bias_correct": False, "gc_bias_correct": False, "num_bias_bins": 0, "mapping_type": "mapping", "num_valid_targets": 0, "num_decoy_targets": 0, "num_eq_classes": 0,
    "eq_class_properties": [], "length_classes": [], "num_bootstraps": 0, "num_processed": 0, "num_mapped": 0, "num_decoy_fragments": 0, "num_dovetail_fragments": 0,
    "num_fragments_filtered": 0, "percent_mapped": 0.0, "start_time": None, "end_time": None,
}


def run_facts(dist: DataFrame | None = None, **known) -> dict:
    """Facts of a run in their order; those of the length distribution (length, p) and the share of mapped fragments follow
    from what is given. Without anything they are those of an empty run, and an error says why."""
    if unknown := set(known) - set(FACTS):
        raise ValueError(f"no such facts: {', '.join(sorted(unknown))}")
    facts = {**FACTS, **known}
    if dist is not None:
        m = dist.agg(F.count("*").alias("n"), F.sum(F.col("p") * F.col("length")).alias("mean"), F.sum(F.col("p") * F.col("length") ** 2).alias("square")).first()
        facts |= {"frag_dist_length": m.n, "frag_length_mean": m["mean"] or 0.0, "frag_length_sd": max(0.0, (m.square or 0.0) - (m["mean"] or 0.0) ** 2) ** 0.5}
    if facts["num_processed"]:
        facts["percent_mapped"] = 100.0 * facts["num_mapped"] / facts["num_processed"]
    if not facts["num_mapped"] and not facts["quant_errors"]:
        facts["quant_errors"] = ["insufficient_assigned_fragments"]
    return facts


def write_simple_classes(counts: DataFrame, targets: DataFrame, path: str) -> None:
    write_classes(classes.collapse(counts), targets, path)


def write_json(values: dict, spark, path: str) -> None:
    """One object, such as a run's facts or its options."""
    import json

    spark.createDataFrame([(json.dumps(values, sort_keys=True, default=str),)], "value string").coalesce(1).write.text(path)


def write_samples(samples: DataFrame, path: str) -> None:
    """Draws (sample_id, tid, alpha), a folder for each."""
    samples.write.partitionBy("sample_id").parquet(path)


def samples_wide(samples: DataFrame, draws: list[int]) -> DataFrame:
    """A row for each target and a column for each draw."""
    return samples.groupBy("tid").pivot("sample_id", draws).agg(F.first("alpha"))


def sam_lines(alignments: DataFrame) -> DataFrame:
    """Alignment lines from columns named as the fields are, with an AS tag from score."""
    fields = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    return alignments.select(F.concat_ws("\t", *(F.coalesce(F.col(f).cast("string"), F.lit("*")) for f in fields), F.concat(F.lit("AS:i:"), F.col("score").cast("string"))).alias("value"))


def unmapped_lines(codes: DataFrame) -> DataFrame:
    """Names of fragments without a pair, with the reason."""
    return codes.filter(F.col("code") != "p").select(F.concat_ws(" ", F.col("frag").cast("string"), "code").alias("value"))
