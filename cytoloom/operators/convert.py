"""From one read format to another."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cytoloom.functions import sequence as S
from cytoloom.operators.layout import numbered


def number_reads(reads: DataFrame, order: str = "ordinal") -> DataFrame:
    """Reads with ``num``, their number within the cell in file order from 0."""
    return numbered(reads, [order], ["cell_id"])


def to_fastq(reads: DataFrame, order: str = "ordinal") -> DataFrame:
    """(cell_id, num, r1_fastq, r2_fastq): four lines for each mate, named cell:umi:number and the mate."""
    def lines(mate: int):
        return F.concat(F.lit("@"), S.read_name("cell_id", "umi", "num"), F.lit(f" {mate}\n"), F.col(f"r{mate}"), F.lit("\n+\n"), F.col(f"q{mate}"))

    return number_reads(reads, order).select("cell_id", "num", lines(1).alias("r1_fastq"), lines(2).alias("r2_fastq"))


def library_cell(library: str):
    return F.concat(F.lit(f"{library}_"), "cell_id") if library else F.col("cell_id")


def tirp_line(library: str = ""):
    """The eight tab-separated columns of a read; a read and its quality must be of one length."""
    same = (F.length("r1") == F.length("q1")) & (F.length("r2") == F.length("q2"))
    line = F.concat_ws("\t", library_cell(library), F.lit("1"), F.lit("1"), "r1", "r2", "q1", "q2", F.coalesce("umi", F.lit("")))
    return F.when(same, line).otherwise(F.raise_error(F.lit("read and quality differ in length")).cast("string"))


def to_tirp(reads: DataFrame, library: str = "") -> DataFrame:
    """Each read's line as ``value``."""
    return reads.select("cell_id", tirp_line(library).alias("value"))


def fasta_to_reads(files: DataFrame) -> DataFrame:
    """Each record of FASTA files (cell_id, content as text) as a read with quality F."""
    records = files.select("cell_id", F.explode(F.split(F.concat(F.lit("\n"), F.col("content").cast("string")), "\n>")).alias("rec")).where(F.trim("rec") != "")
    seq = F.regexp_replace(F.regexp_replace("rec", "^[^\n]*", ""), "\\s", "")
    return records.select("cell_id", seq.alias("r1")).where("r1 <> ''").select("cell_id", "r1", F.lit("").alias("r2"), F.expr("repeat('F', length(r1))").alias("q1"), F.lit("").alias("q2"), F.lit("").alias("umi"))


def bam_to_reads(alignments: DataFrame) -> DataFrame:
    """Read pairs as they were sequenced: primary records only, reverse ones turned back, mates joined by name.

    A mate that is missing leaves its side null; ``complete`` tells.
    """
    main = alignments.where(~S.has_flag("flag", S.SECONDARY | S.SUPPLEMENTARY))
    back = S.has_flag("flag", S.REVERSE)
    seq = F.when(back, S.complement(F.reverse("seq"))).otherwise(F.col("seq"))
    qual = F.when(back, F.reverse("qual")).otherwise(F.col("qual"))
    first = S.has_flag("flag", S.FIRST) | ~S.has_flag("flag", S.PAIRED)
    rows = main.select("file_id", "qname", seq.alias("s"), qual.alias("q"), first.alias("first"))
    one = lambda c, mate: F.max(F.when(F.col("first") == mate, F.col(c)))
    pairs = rows.groupBy("file_id", "qname").agg(one("s", True).alias("r1"), one("s", False).alias("r2"), one("q", True).alias("q1"), one("q", False).alias("q2"))
    return pairs.select(S.qname_cell("qname").alias("cell_id"), "r1", "r2", "q1", "q2", S.qname_umi("qname").alias("umi"), (F.col("r1").isNotNull() & F.col("r2").isNotNull()).alias("complete"))


def reads_to_files(reads: DataFrame, order: str = "ordinal") -> DataFrame:
    """Each cell's reads as the files r1.fq and r2.fq, for functions over cells.

    A file is one row, as such functions need it; cap very large cells with ``filters.first_per_cell`` before.
    """
    rows = to_fastq(reads, order)

    def one(mate: int) -> DataFrame:
        lines = F.transform(F.array_sort(F.collect_list(F.struct("num", F.col(f"r{mate}_fastq").alias("t")))), lambda x: x["t"])
        text = F.concat(F.array_join(lines, "\n"), F.lit("\n"))
        return rows.groupBy("cell_id").agg(text.alias("text")).select("cell_id", F.lit(f"r{mate}.fq").alias("file_name"), F.encode("text", "utf-8").alias("content"))

    return one(1).unionByName(one(2))
