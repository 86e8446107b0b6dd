"""Column expressions on sequences, read names, flags and CIGARs; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PAIRED, UNMAPPED, REVERSE, FIRST, LAST, SECONDARY, SUPPLEMENTARY = 0x1, 0x4, 0x10, 0x40, 0x80, 0x100, 0x800


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def revcomp(seq: Column | str) -> Column:
    """Reverse complement; N and other letters stay."""
    return F.reverse(F.translate(_col(seq), "ACGT", "TGCA"))


def complement(seq: Column | str) -> Column:
    """Base by base, in either case."""
    return F.translate(_col(seq), "ACGTacgt", "TGCAtgca")


def kmers(seq: Column | str, k: int) -> Column:
    """All windows of k letters as an array; empty where the sequence is shorter or null."""
    s = _col(seq)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (k - 1), F.lit(1))), lambda i: F.substr(s, i, F.lit(k)))
    return F.when(F.length(s) >= k, windows).otherwise(F.array().cast("array<string>"))


def canonical(kmer: Column | str) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(_col(kmer), revcomp(kmer))


def umi_code(umi: Column | str) -> Column:
    """Two bits a base, A 0, T 1, G 2, C 3; null for other letters."""
    u = _col(umi)
    return F.when(u.rlike("^[ATGC]+$"), F.conv(F.translate(u, "ATGC", "0123"), 4, 10).cast("long"))


def umi_bit_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Places in which two sequences of one length differ; an N differs from everything."""
    pair = F.zip_with(F.split(_col(a), ""), F.split(_col(b), ""), lambda x, y: F.when((x == y) & (x != "N"), 0).otherwise(1))
    return F.aggregate(pair, F.lit(0), lambda s, x: s + x)


def qname_cell(qname: Column | str) -> Column:
    """The cell of a read name cell:umi:number."""
    return F.split_part(_col(qname), F.lit(":"), F.lit(1))


def qname_umi(qname: Column | str) -> Column:
    return F.split_part(_col(qname), F.lit(":"), F.lit(2))


def qname_prefix(qname: Column | str) -> Column:
    """What stands before the first double colon, as the coverage reports read a name."""
    return F.substring_index(_col(qname), "::", 1)


def read_name(cell: Column | str, umi: Column | str, number: Column | str) -> Column:
    return F.concat_ws(":", _col(cell), F.coalesce(_col(umi), F.lit("")), _col(number).cast("string"))


def cell_name(wells: list[Column | str], library: str = "") -> Column:
    """Well names joined by underscores, behind the library's name if there is one."""
    name = F.concat_ws("_", *[_col(w) for w in wells])
    return F.concat(F.lit(f"{library}_"), name) if library else name


def trim_poly_t(seq: Column | str) -> Column:
    return F.regexp_replace(_col(seq), "^T+", "")


def has_flag(flag: Column | str, bit: int) -> Column:
    return _col(flag).bitwiseAND(bit) != 0


def _cigar_sum(cigar: Column | str, ops: str) -> Column:
    return F.aggregate(F.filter(_col(cigar), lambda x: F.lit(ops).contains(x["op"])), F.lit(0).cast("long"), lambda a, x: a + x["len"])


def matched_bases(cigar: Column | str) -> Column:
    return _cigar_sum(cigar, "M")


def reference_span(cigar: Column | str) -> Column:
    return _cigar_sum(cigar, "MDN=X")


def aligned_blocks(pos: Column | str, cigar: Column | str) -> Column:
    """Array of (start, end) of the blocks in which bases lie on the reference (M, = and X)."""
    start = F.struct(_col(pos).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("blocks"))

    def step(state: Column, x: Column) -> Column:
        stop = state["at"] + F.when(F.lit("MDN=X").contains(x["op"]), x["len"]).otherwise(0)
        block = F.when(F.lit("M=X").contains(x["op"]), F.array(F.struct(state["at"].alias("start"), stop.alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
        return F.struct(stop.alias("at"), F.concat(state["blocks"], block).alias("blocks"))

    return F.aggregate(_col(cigar), start, step, lambda s: s["blocks"])


def sam_tags(line: Column | str) -> Column:
    """A SAM line with CB and UB tags from its read name; old ones go, header lines stay."""
    text = _col(line)
    bare = F.regexp_replace(text, "\t(CB|UB):Z:[^\t]*", "")
    name = F.split_part(text, F.lit("\t"), F.lit(1))
    umi = qname_umi(name)
    tagged = F.concat(bare, F.lit("\tCB:Z:"), qname_cell(name), F.when(umi != "", F.concat(F.lit("\tUB:Z:"), umi)).otherwise(F.lit("")))
    return F.when(text.startswith("@"), text).otherwise(tagged)


def genome_url(ftp_path: Column | str) -> Column:
    """The address of an assembly's FASTA file from its directory."""
    path = F.regexp_replace(F.rtrim(_col(ftp_path), F.lit("/")), "^ftp://", "https://")
    return F.concat(path, F.lit("/"), F.substring_index(path, "/", -1), F.lit("_genomic.fna.gz"))
