"""Column expressions over sequences, variants and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC nucleotide codes.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reverse_complement(seq) -> Column:
    """Reverse complement of a sequence over A, C, G, T and N; an error for other letters; null stays null."""
    s = _c(seq)
    return F.when(s.rlike("^[ACGTN]*$"), F.reverse(F.translate(s, "ACGTN", "TGCAN"))).when(s.isNull(), F.lit(None).cast("string")).otherwise(F.raise_error(F.concat(F.lit("not a sequence: "), F.substring(s, 1, 40))))


def complement(seq) -> Column:
    return F.translate(_c(seq), "ACGTN", "TGCAN")


def fraction_of(seq, letters: str) -> Column:
    """Share of the sequence's characters that are one of letters; null for an empty sequence."""
    s = _c(seq)
    return F.try_divide((F.length(s) - F.length(F.translate(s, letters, ""))).cast("double"), F.length(s).cast("double"))


def motif_pattern(motif: str) -> str:
    """A regular expression for an IUPAC motif."""
    return "".join(IUPAC[x] if len(IUPAC[x]) == 1 else f"[{IUPAC[x]}]" for x in motif.upper())


def motif_count(seq, motif: str) -> Column:
    """Occurrences of an IUPAC motif, overlapping ones included."""
    return F.regexp_count(_c(seq), F.lit(f"(?={motif_pattern(motif)})"))


def motif_starts(seq, motif: str) -> Column:
    """Ascending 0-based starts of an IUPAC motif, overlapping ones included.

    The text between look-ahead cuts tells the positions, so the sequence is scanned once, not once per position.
    """
    pieces = F.split(_c(seq), f"(?={motif_pattern(motif)})", -1)
    lengths = F.transform(pieces, F.length)
    ends = F.aggregate(lengths, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)))
    first = F.when(_c(seq).rlike(f"^{motif_pattern(motif)}"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.when(_c(seq).isNotNull(), F.array_distinct(F.concat(first, F.filter(F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))), lambda x: x >= 0))))


def kmers(seq, k: int, letters: str = "ACGT") -> Column:
    """All k-mers over the letters, overlapping ones included; anything else breaks them."""
    return F.regexp_extract_all(_c(seq), F.lit(f"(?=([{letters}]{{{k}}}))"), 1)


def chromosome(name) -> Column:
    """chr1 for 1 or Chr1; chrM for M or MT."""
    bare = F.regexp_replace(_c(name), "^(?i)chr", "")
    return F.when(F.upper(bare).isin("M", "MT"), F.lit("chrM")).otherwise(F.concat(F.lit("chr"), bare))


def chromosome_rank(name) -> Column:
    """Numbers of chromosomes for sorting; 99 for those without."""
    return F.coalesce(F.regexp_replace(_c(name), "^(?i)chr", "").try_cast("int"), F.lit(99))


def variant_type(ref, alt) -> Column:
    """SNV, Indel or Unsupported (several bases of equal length, symbolic alleles, N in a substitution)."""
    r, a = F.upper(_c(ref)), F.upper(_c(alt))
    base = lambda x: x.rlike("^[ACGT]$")
    plain = r.rlike("^[ACGTN]+$") & a.rlike("^[ACGTN]+$")
    return F.when(base(r) & base(a) & (r != a), F.lit("SNV")).when(plain & (F.length(r) != F.length(a)), F.lit("Indel")).otherwise(F.lit("Unsupported"))


def variant_id(chrom, pos, ref, alt) -> Column:
    return F.concat_ws(":", _c(chrom), _c(pos).cast("string"), F.upper(_c(ref)), F.upper(_c(alt)))


def parse_variant(text) -> Column:
    """struct(chrom, pos0, ref, alt) of chrom:pos:ref:alt; null unless there are four fields and a whole number."""
    f = F.split(_c(text), ":")
    pos = F.get(f, F.lit(1)).try_cast("long") - 1
    return F.when((F.size(f) == 4) & pos.isNotNull(), F.struct(F.get(f, F.lit(0)).alias("chrom"), pos.alias("pos0"), F.get(f, F.lit(2)).alias("ref"), F.get(f, F.lit(3)).alias("alt")))


def motif_spans(seq, motif: str) -> Column:
    """array of struct(start, end): matches of an IUPAC motif from left to right, none overlapping the one before it."""
    pieces = F.split(_c(seq), motif_pattern(motif), -1)
    width, lengths = len(motif), F.transform(pieces, F.length)
    empty = F.array().cast("array<int>")
    ends = F.aggregate(F.slice(lengths, 1, F.greatest(F.size(lengths) - 1, F.lit(0))), empty, lambda acc, n: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n + width))
    return F.transform(ends, lambda e: F.struct((e - width).alias("start"), e.alias("end")))


def interval_parts(identifier) -> Column:
    """struct(event, exon, region) of an interval's name: the event, which exon it lies at (mic, c1, c2) and its region.

    Names are event, event_region, event_exon or event_exon_region; events called putative_x_n have a number and stand
    for putative_microexon_n. An event alone, or an exon alone, means the exon itself: region ex.
    """
    words = F.split(_c(identifier), "_")
    putative = F.get(words, F.lit(0)) == "putative"
    event = F.when(putative, F.concat(F.lit("putative_microexon_"), F.get(words, F.lit(2)))).otherwise(F.get(words, F.lit(0)))
    at = F.when(putative, 3).otherwise(1)
    first, second = F.get(words, at), F.get(words, at + 1)
    outer = F.coalesce(first.isin("c1", "c2"), F.lit(False))
    return F.struct(event.alias("event"), F.when(outer, first).otherwise("mic").alias("exon"), F.coalesce(F.when(outer, second).otherwise(first), F.lit("ex")).alias("region"))


def base_codes(seq, letters: str = "ACTG", other: int = 6) -> Column:
    """array<int>: each letter's place in letters, in any case; other for anything else."""
    return F.transform(F.filter(F.split(F.upper(_c(seq)), ""), lambda x: x != ""), lambda x: F.when(x.isin(*letters), F.position(x, F.lit(letters)) - 1).otherwise(other))


def variant_list(text) -> Column:
    """Distinct variants of "[a,b]", "a,b" or "a|b"; entries without four fields are left out."""
    parts = F.split(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"[\[\]'\" ]", ""), "[,|]")
    return F.array_distinct(F.filter(parts, lambda x: F.size(F.split(x, ":")) == 4))


def info_value(info, names: list[str], allele: int | Column = 1) -> Column:
    """The allele's value of the first of these INFO keys that is there; "." else."""
    m = F.str_to_map(_c(info), F.lit(";"), F.lit("="))
    allele = F.lit(allele) if isinstance(allele, int) else allele
    values = [F.split(F.try_element_at(m, F.lit(n)), ",") for n in names]
    return F.coalesce(*(F.when(F.size(v) > 1, F.try_element_at(v, allele)).otherwise(F.get(v, F.lit(0))) for v in values), F.lit("."))


def passes_filter(c) -> Column:
    """FILTER is empty, "." or exactly PASS."""
    return _c(c).isNull() | _c(c).isin("PASS", ".", "")


def splice(seq, pos0, ref, alt) -> Column:
    """The sequence with ref at 0-based pos0 replaced by alt; an error where ref isn't there."""
    s, p, r = _c(seq), _c(pos0), _c(ref)
    there = s.substr(p + 1, F.length(r)) == r
    return F.when(there, F.concat(s.substr(F.lit(1), p), _c(alt), s.substr(p + F.length(r) + 1, F.length(s)))).otherwise(F.raise_error(F.lit("reference allele mismatch")))


def padded_window(seq, seq_start, start, end) -> Column:
    """[start, end) of a chromosome from a piece that begins at seq_start, with N where the piece doesn't reach."""
    s, offset = _c(seq), _c(seq_start)
    size = _c(end) - _c(start)
    left = F.least(F.greatest(offset - _c(start), F.lit(0)), size)
    right = F.least(F.greatest(_c(end) - (offset + F.length(s)), F.lit(0)), size - left)
    body = s.substr(F.greatest(_c(start) - offset, F.lit(0)).cast("int") + 1, (size - left - right).cast("int"))
    return F.concat(F.repeat(F.lit("N"), left.cast("int")), body, F.repeat(F.lit("N"), right.cast("int")))


def event_region(name) -> Column:
    """struct(event, region) of "<event>_<region>", cut at the last "_"."""
    return F.struct(F.regexp_extract(_c(name), "^(.*)_[^_]*$", 1).alias("event"), F.substring_index(_c(name), "_", -1).alias("region"))


def mutation_id(text) -> Column:
    """struct(event, region, rel_pos, ref, alt) of "<event>_<two letters and a whole number>_<ref>:<alt>"; null for anything else."""
    part = lambda i: F.regexp_extract(_c(text), r"^([^_]+)_(..)([+-]?\d+)_([^:_]+):([^:_]+)$", i)
    made = F.struct(part(1).alias("event"), part(2).alias("region"), part(3).try_cast("int").alias("rel_pos"), part(4).alias("ref"), part(5).alias("alt"))
    return F.when(part(1) != "", made)


def format_value(fmt, sample, name: str) -> Column:
    """A sample's value of a FORMAT key; null where the key or the value isn't there."""
    return F.nullif(F.try_element_at(F.map_from_arrays(F.split(_c(fmt), ":"), F.slice(F.concat(F.split(_c(sample), ":"), F.array_repeat(F.lit("."), F.size(F.split(_c(fmt), ":")))), F.lit(1), F.size(F.split(_c(fmt), ":")))), F.lit(name)), F.lit("."))


def good_genotype(filter_, ref, alt, fmt, sample) -> Column:
    """Whether a genotype is good enough: FILTER is PASS, 10 reads or more, and heterozygous with 0.3 to under 0.8 of
    them for the second allele and quality 99 (90 for length changes), or homozygous for an alternative allele with 0.8
    of them and quality 25. False where a value is missing."""
    value = lambda n: format_value(fmt, sample, n)
    alleles = F.split(value("GT"), "[/|]")
    first, second = F.get(alleles, F.lit(0)), F.get(alleles, F.lit(1))
    depth, quality = value("DP").try_cast("int"), value("GQ").try_cast("double")
    share = F.get(F.split(value("AD"), ","), F.lit(1)).try_cast("double") / F.when(depth > 0, depth)
    same_length = F.length(_c(ref)) == F.length(F.get(F.split(_c(alt), ","), F.lit(0)))
    het = (first != second) & (quality >= F.when(same_length, 99).otherwise(90)) & (share >= 0.3) & (share < 0.8)
    hom = (first == second) & ~first.isin("0", ".") & (quality >= 25) & (share >= 0.8)
    return F.coalesce((_c(filter_) == "PASS") & (depth >= 10) & (het | hom), F.lit(False))
