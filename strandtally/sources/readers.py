"""Files as DataFrames. Lines are numbered within their file by Spark, so that records of several lines,
and mates in two files, are put together by joins and groupings on file and number, never by arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

EXTENSIONS = ("fasta", "fastq", "fa", "fq", "gz")  # fixed values


def check_sources(left: list[str], right: list[str] | None = None) -> None:
    """Names of read files: at least one, mates in pairs, known extensions."""
    if not left:
        raise ValueError("no read files")
    if right is not None and len(left) != len(right):
        raise ValueError(f"{len(left)} files of first mates and {len(right)} of second ones")
    if bad := [p for p in [*left, *(right or [])] if p.rsplit(".", 1)[-1].lower() not in EXTENSIONS]:
        raise ValueError(f"unknown kinds of files: {', '.join(bad)}")


def numbered_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, line, value): lines in the order of each file.

    Spark's text reader takes a file's parts in order of their offsets; a line's number is the number of lines in
    the parts before its own, plus its place in its part. Only counts of parts are summed up, not lines."""
    lines = spark.read.text(paths).select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, int] = {}  # parts of files that one task reads
        for pdf in batches:
            n = pdf.groupby(["file", "block"]).cumcount()
            first = [seen.get(k, 0) for k in zip(pdf["file"], pdf["block"], strict=True)]
            for k, c in pdf.groupby(["file", "block"]).size().items():
                seen[k] = seen.get(k, 0) + int(c)
            yield pdf.assign(at=n.to_numpy() + first)

    placed = lines.mapInPandas(place, "file string, block long, value string, at long")
    parts = placed.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(parts.select("file", "block", before.alias("before")), ["file", "block"]).select("file", (F.col("before") + F.col("at")).alias("line"), "value")


def lines_in_order(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines of a file, or of the parts below a folder one after the other by name."""
    lines = numbered_lines(spark, path)
    sizes = lines.groupBy("file").agg(F.count("*").alias("n"))
    before = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each file
    return lines.join(F.broadcast(before), "file").select((F.col("before") + F.col("line")).alias("line"), "value")


def read_bias_models(spark: SparkSession, path: str) -> DataFrame:
    """(kind, model, a, b, mass) as write_bias_models leaves them."""
    return spark.read.parquet(path).select("kind", "model", "a", "b", "mass")


def read_fastq(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, rec, name, seq, qual): records of four lines."""
    lines = numbered_lines(spark, paths).withColumn("rec", F.floor(F.col("line") / 4)).withColumn("k", F.col("line") % 4)
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    rows = lines.groupBy("file", "rec").agg(pick(0).alias("head"), pick(1).alias("seq"), pick(3).alias("qual"))
    return rows.select("file", "rec", _first_word(F.substring("head", 2, 1 << 30)).alias("name"), "seq", "qual")


def read_fasta(spark: SparkSession, paths: list[str] | str, bar_ends_name: bool = False, lines_each: int = 100_000) -> DataFrame:
    """(file, rec, name, seq): sequences over any number of lines. bar_ends_name: names end at a vertical bar too.

    A record is known by the line that begins it. Lines fall into blocks; the last beginning in each block is carried
    over to the blocks after it, a row for each block, and within a block lines take the last beginning before them."""
    lines = numbered_lines(spark, paths).filter(F.length("value") > 0).withColumn("block", F.floor(F.col("line") / lines_each))
    starts = F.when(F.col("value").startswith(">"), F.col("line"))
    carried = lines.groupBy("file", "block").agg(F.max(starts).alias("begun"))
    carried = carried.select("file", "block", F.max("begun").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("begun"))
    own = F.max(starts).over(Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("own", own).join(carried, ["file", "block"]).withColumn("rec", F.coalesce("own", "begun")).filter("rec is not null")
    head = F.max(F.when(F.col("line") == F.col("rec"), F.substring("value", 2, 1 << 30)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line") != F.col("rec"), F.struct("line", "value")))), lambda x: x["value"]), "")  # of one sequence
    rows = lines.groupBy("file", "rec").agg(head.alias("head"), body.alias("seq"))
    name = _first_word(F.col("head"))
    return rows.select("file", "rec", (F.split(name, r"\|")[0] if bar_ends_name else name).alias("name"), F.upper("seq").alias("seq"))


def _first_word(text: Column) -> Column:
    return F.regexp_extract(text, r"^(\S*)", 1)


def only_bases(seq: Column, name: Column, seed: int = 17) -> Column:
    """Letters other than A, C, G and T replaced by bases that a hash of the name and the place gives."""
    letters = F.split(seq, "")
    return F.array_join(F.transform(letters, lambda c, i: F.when((c == "") | c.isin("A", "C", "G", "T"), c).otherwise(F.substring(F.lit("ACGT"), (F.pmod(F.xxhash64(name, i, F.lit(seed)), F.lit(4)) + 1).cast("int"), F.lit(1)))), "")


def duplicate_names(targets: DataFrame) -> DataFrame:
    return targets.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")


def paired_reads(left: DataFrame, right: DataFrame, files: list[tuple[str, str]]) -> DataFrame:
    """(pair, rec, name, seq1, qual1, seq2, qual2): mates of the files of each pair, joined by their place in these."""
    spark = left.sparkSession
    pairs = F.broadcast(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(files)], "pair int, a string, b string"))
    ends = lambda df, c: df.join(pairs.select("pair", c), df["file"].endswith(pairs[c]))
    one = ends(left, "a").select("pair", "rec", "name", F.col("seq").alias("seq1"), F.col("qual").alias("qual1"))
    two = ends(right, "b").select("pair", "rec", F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    return one.join(two, ["pair", "rec"], "full")


def check_mates(pairs: DataFrame) -> DataFrame:
    """``pairs`` of paired_reads, if every read has its mate; otherwise an error that names the first place."""
    odd = pairs.filter("seq1 is null or seq2 is null").orderBy("pair", "rec").first()
    if odd is not None:
        raise ValueError(f"files of pair {odd.pair} have different numbers of reads: record {odd.rec} has no mate")
    return pairs


_SAM = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
_NUMBERS = ("flag", "pos", "mapq", "pnext", "tlen")


def read_sam(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, line, the eleven fields, score): alignment lines, score from the tag AS or null."""
    lines = numbered_lines(spark, paths).filter(~F.col("value").startswith("@") & (F.length("value") > 0)).withColumn("f", F.split("value", "\t"))
    cols = [F.col("f")[i].cast("int").alias(n) if n in _NUMBERS else F.col("f")[i].alias(n) for i, n in enumerate(_SAM)]
    return lines.select("file", "line", *cols, F.nullif(F.regexp_extract("value", r"\tAS:i:(-?\d+)", 1), F.lit("")).cast("int").alias("score"))


def read_sam_header(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, ord, name, len, decoy) of the targets in headers."""
    lines = numbered_lines(spark, paths).filter(F.col("value").startswith("@SQ"))
    tag = lambda t: F.regexp_extract("value", rf"\t{t}:([^\t]*)", 1)
    return lines.select("file", F.col("line").alias("ord"), tag("SN").alias("name"), tag("LN").cast("int").alias("len"), (tag("DS") == "D").alias("decoy"))


def refuse_decoys(headers: DataFrame) -> DataFrame:
    """``headers`` of read_sam_header without decoys; alignments that name some can't be counted and are an error."""
    decoys = headers.filter("decoy").select("name").distinct()
    if first := decoys.orderBy("name").first():
        raise ValueError(f"{decoys.count()} targets are decoys, such as {first.name}: write alignments without them")
    return headers


def looks_paired(sam: DataFrame) -> bool | None:
    """Whether the first alignment belongs to a pair; None if there is none. All that is read is one row."""
    row = sam.select(F.col("flag").bitwiseAND(0x1).alias("bit")).first()
    return None if row is None else bool(row.bit)


def aligner(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, program): the first program that a header names, in lower case."""
    lines = numbered_lines(spark, paths).filter(F.col("value").startswith("@PG"))
    return lines.groupBy("file").agg(F.lower(F.min_by(F.regexp_extract("value", r"\tPN:([^\t]*)", 1), "line")).alias("program"))


def headers_agree(headers: DataFrame) -> bool:
    """Whether all files name the same targets, in one order and of the same lengths."""
    ranked = headers.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("ord")))
    files = headers.select("file").distinct().count()
    return not ranked.groupBy("r", "name", "len").agg(F.count("*").alias("n")).filter(F.col("n") != files).limit(1).count()


def usable_alignments(sam: DataFrame) -> DataFrame:
    """Without duplicates, failed and unmapped reads."""
    return sam.filter((F.col("flag").bitwiseAND(0x4 | 0x200 | 0x400) == 0) & (F.col("rname") != "*"))


def alignment_kind(sam: DataFrame) -> DataFrame:
    """With kind: paired (both on one target, properly), orphan, or unmapped."""
    bit = lambda b: F.col("flag").bitwiseAND(b) != 0
    paired = bit(0x2) & ~bit(0x4) & ~bit(0x8) & F.col("rnext").isin("=", "*")
    return sam.withColumn("kind", F.when(bit(0x4), "unmapped").when(paired, "paired").otherwise("orphan"))


def sam_pairs(sam: DataFrame) -> DataFrame:
    """Mates of a fragment on one target, joined by name and mutual place: first mate's row with the second's pos and strand."""
    bit = lambda b: F.col("flag").bitwiseAND(b) != 0
    name = F.regexp_replace("qname", "/[12]$", "")
    one = sam.filter(bit(0x40)).withColumn("frag", name)
    two = sam.filter(bit(0x80)).select(name.alias("frag"), "rname", F.col("pos").alias("mate_pos"), F.col("pnext").alias("back"), (~bit(0x10)).alias("mate_fwd"))
    joined = one.withColumn("fwd", ~bit(0x10)).join(two, ["frag", "rname"])
    return joined.filter((F.col("pnext") == F.col("mate_pos")) & (F.col("pos") == F.col("back"))).drop("back")


def read_classes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Targets (tid, name, eff_len), counts (class_id, n) and members (class_id, tid, w) of a class file, or of its parts
    in a folder; tid is the target's place in the file.

    The file has the number of targets, of classes, the names, then for each class: size, targets, weights
    (or none), count; then lines of name and effective length, where missing ones count as 100."""
    lines = lines_in_order(spark, path)
    n, m = (int(r.value) for r in lines.filter("line < 2").orderBy("line").collect())  # two lines
    names = lines.filter(F.col("line").between(2, n + 1)).select((F.col("line") - 2).cast("int").alias("tid"), F.trim("value").alias("name"))
    tail = lines.filter(F.col("line") >= 2 + n + m).select(F.split(F.trim("value"), r"\s+").alias("f")).filter(F.size("f") == 2).select(F.col("f")[0].alias("name"), F.col("f")[1].cast("double").alias("e"))
    targets = names.join(tail, "name", "left").select("tid", "name", F.coalesce("e", F.lit(100.0)).alias("eff_len"))
    rows = lines.filter(F.col("line").between(2 + n, 1 + n + m)).select((F.col("line") - 2 - n).alias("class_id"), F.split(F.trim("value"), r"\s+").alias("f"))
    k = F.col("f")[0].cast("int")
    weighted = F.size("f") == 2 * k + 2
    counts = rows.select("class_id", F.element_at("f", -1).cast("long").alias("n"))
    tids = F.slice("f", F.lit(2), k).cast("array<int>")
    w = F.when(weighted, F.slice("f", k + 2, k).cast("array<double>")).otherwise(F.array_repeat(F.lit(1.0), k))
    members = rows.select("class_id", F.explode(F.arrays_zip(tids.alias("tid"), w.alias("w"))).alias("x")).select("class_id", "x.tid", "x.w")
    return targets, counts, members


def read_class_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Targets (tid, name) and members (key, n, tid, w) of the two tables that write_classes makes.

    Only the targets' order counts, by file and line; each class stands on a line of its own, of which there may be any
    number of files."""
    names = numbered_lines(spark, f"{path}/targets")
    sizes = names.groupBy("file").agg(F.count("*").alias("n"))
    before = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each file
    targets = names.join(F.broadcast(before), "file").select((F.col("before") + F.col("line")).cast("int").alias("tid"), F.col("value").alias("name"))
    rows = spark.read.text(f"{path}/classes").select(F.split("value", "\t").alias("f")).withColumn("k", F.col("f")[0].cast("int"))
    tids = F.slice("f", F.lit(2), F.col("k"))
    w = F.when(F.size("f") == 2 * F.col("k") + 2, F.slice("f", F.col("k") + 2, F.col("k")).cast("array<double>")).otherwise(F.array_repeat(F.lit(1.0), F.col("k")))
    each = rows.select(F.array_join(tids, ",").alias("key"), F.element_at("f", -1).cast("long").alias("n"), F.explode(F.arrays_zip(tids.cast("array<int>").alias("tid"), w.alias("w"))).alias("x"))
    return targets, each.select("key", "n", "x.tid", "x.w")


def read_gene_map(spark: SparkSession, path: str) -> DataFrame:
    """(name, gene) of a file of two words a line; a name's first gene counts."""
    rows = numbered_lines(spark, path).select("line", F.split(F.trim("value"), r"\s+").alias("f")).filter(F.size("f") >= 2)
    return rows.groupBy(F.col("f")[0].alias("name")).agg(F.min_by(F.col("f")[1], "line").alias("gene"))


def read_gtf(spark: SparkSession, path: str, key: str = "gene_id", feature: str = "transcript") -> DataFrame:
    """(name, gene) of transcript lines; of several genes of a name the first by place."""
    rows = numbered_lines(spark, path).filter(~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t")).filter((F.size("f") >= 9) & (F.col("f")[2] == feature))
    tag = lambda t: F.regexp_extract(F.col("f")[8], rf'(?:^|;)\s*{t}[ =]"?([^";]+)"?', 1)
    rows = rows.select("line", tag("transcript_id").alias("name"), tag(key).alias("gene")).filter("name != ''")
    return rows.groupBy("name").agg(F.min_by("gene", "line").alias("gene"))


def read_abundances(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(sample, name, length, effective_length, tpm, num_reads); a sample is named by its folder."""
    schema = T.StructType([T.StructField("name", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("length", "effective_length", "tpm", "num_reads"))])
    rows = spark.read.csv(paths, schema=schema, sep="\t", header=True, comment="#")
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("sample"), "*")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(name): words of a list, such as decoys or targets set aside."""
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("name")).filter("name != ''").distinct()


def flag_targets(targets: DataFrame, names: DataFrame, flag: str) -> DataFrame:
    return targets.join(names.select("name", F.lit(True).alias(flag)), "name", "left").na.fill(False, [flag])
