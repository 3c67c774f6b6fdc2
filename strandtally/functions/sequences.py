"""Column functions on nucleotide strings. Positions are 0-based unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(text: Column) -> Column:
    """The nucleotides of any text, in upper case."""
    return F.upper(F.regexp_replace(text, "[^acgtACGT]", ""))


def reverse_complement(seq: Column) -> Column:
    """Letters other than A, C, G and T become N."""
    return F.translate(F.regexp_replace(F.reverse(F.upper(seq)), "[^ACGT]", "N"), "ACGT", "TGCA")


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def kmers(seq: Column, k: int) -> Column:
    """All k-mers in order; none if the sequence is shorter."""
    last = F.length(seq) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(seq, i + 1, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def kmer_code(kmer: Column) -> Column:
    """A number in base 4 with A=0, C=1, G=2, T=3."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def kmer_text(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def gc_count(seq: Column) -> Column:
    return F.length(seq) - F.length(F.translate(seq, "GC", ""))


def gc_percent(seq: Column, start: Column, length: Column) -> Column:
    """Share of G and C in a window, in whole percent, halves to even; null for an empty window."""
    part = F.substring(seq, start + 1, length)
    return F.rint(F.lit(100.0) * gc_count(part) / F.nullif(F.length(part), F.lit(0))).cast("int")


def context_gc_percent(seq: Column, start: Column, length: Column, outside: int = 3, inside: int = 2) -> Column:
    """G and C around both ends of a fragment, in whole percent; windows are cut at the sequence's ends."""
    end = start + length - 1

    def window(a: Column, b: Column) -> Column:
        a, b = F.greatest(a, F.lit(0)), F.least(b, F.length(seq) - 1)
        return F.substring(seq, a + 1, F.greatest(b - a + 1, F.lit(0)))

    both = F.concat(window(start - outside, start + inside - 1), window(end - inside + 1, end + outside))
    return F.rint(F.lit(100.0) * gc_count(both) / F.nullif(F.length(both), F.lit(0))).cast("int")


def starts(seq: Column, first: int, length: int, step: int) -> Column:
    """Array of the places first, first + step, ... at which ``length`` letters still lie on the sequence."""
    return F.when(F.length(seq) >= first + length, F.sequence(F.lit(first), F.length(seq) - length, F.lit(step))).otherwise(F.array().cast("array<int>"))


def percent_bin(percent: Column, bins: int) -> Column:
    return F.least(F.lit(bins - 1), F.floor(percent / F.lit(100.0 / bins)).cast("int"))


def clip_poly_a(seq: Column, least: int = 10) -> Column:
    """Without a run of ``least`` or more A at the end."""
    return F.regexp_replace(seq, f"A{{{least},}}$", "")


def cigar_operations(cigar: Column) -> Column:
    """Array of (n, op)."""
    lengths, ops = (F.regexp_extract_all(cigar, F.lit("(\\d+)([MIDNSHPX=])"), F.lit(k)) for k in (1, 2))
    return F.zip_with(lengths, ops, lambda n, op: F.struct(n.cast("int").alias("n"), op.alias("op")))


def cigar_length(cigar: Column, kinds: str) -> Column:
    """Total length of the operations of some kinds, such as MDN=X for the reference span."""
    return F.aggregate(F.filter(cigar_operations(cigar), lambda x: x["op"].isin(*kinds)), F.lit(0), lambda a, x: a + x["n"])


def pack_place(tid: Column, offset: Column) -> Column:
    """Target and offset in one number."""
    return F.shiftleft(tid.cast("long"), 32).bitwiseOR(offset.cast("long"))


def unpack_place(place: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(place, 32).cast("int"), place.bitwiseAND(0xFFFFFFFF).cast("int")


def read_name(name: Column) -> Column:
    """Without a mate's suffix /1 or /2."""
    return F.regexp_replace(name, "/[12]$", "")
