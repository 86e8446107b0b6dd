"""Queries over files: each writes a view in a format of the sources, reads it back and is compared with the view's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cytoloom.functions import sequence as S
from cytoloom.operators import convert, counts, filters, intervals, kmers, regions
from cytoloom.plans import queries as Q
from cytoloom.plans.views import view, with_views
from cytoloom.scratch import materialise, new_folder
from cytoloom.sources import archives, readers
from cytoloom.streaming import counts as streams

QUERIES, ORACLE_SQL = {}, {}
MATES = ["r1", "r2", "q1", "q2", "umi"]


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def _written(rows: DataFrame, name: str, **options: str) -> str:
    path = new_folder(rows.sparkSession, name)
    rows.write.options(**options).text(path)
    return path


def _files(spark: SparkSession, path: str) -> list[str]:
    """The part files of a folder, for sources that take files."""
    return sorted(spark.read.text(path).inputFiles())


@query(f"{Q.READS} select 'lib_' || cell_id as cell_id, r1, r2, q1, q2, umi from reads")
def tirp_files(spark, sf_dir):
    path = new_folder(spark, "tirp")
    readers.write_tirp(view(spark, sf_dir, "reads"), path, "lib")
    return readers.read_tirp(spark, *_files(spark, path)).select("cell_id", *MATES)


BLOCK_ROWS = 40


def _blocked(spark, sf_dir, name: str = "blocks") -> str:
    path = new_folder(spark, name)
    readers.write_blocks(view(spark, sf_dir, "reads"), path, block_rows=BLOCK_ROWS)
    return path


@query(f"{Q.READS} select cell_id, r1, r2, q1, q2, umi from reads")
def blocked_tirp(spark, sf_dir):
    # Ranges of 64 KB, far below a file, so lines and blocks over their borders count.
    return readers.read_tirp(spark, *_files(spark, _blocked(spark, sf_dir)), split_mb=1 / 16).select("cell_id", *MATES)


_WANTED = "('en_src3', 'de_src1', 'fr_src0')"


@query(f"{Q.READS} select cell_id, count(*) as n_reads, cast(sum(length(r1)) as bigint) as bases, cast(ceil(count(*) / {BLOCK_ROWS}.0) as bigint) as n_blocks from reads where cell_id in {_WANTED} group by cell_id")
def tirp_cells(spark, sf_dir):
    # Only the blocks of three cells are inflated, each once.
    index = readers.cell_index(readers.read_blocks(spark, *_files(spark, _blocked(spark, sf_dir))))
    rows = readers.read_cells(materialise(index, "index"), spark.sql(f"select explode(array{_WANTED}) as cell_id"))
    return rows.groupBy("cell_id").agg(F.count("r1").alias("n_reads"), F.sum(F.length("r1")).alias("bases"), F.sum("n_blocks").alias("n_blocks"))


@query(f"{Q.READS} select cell_id, r1, r2, q1, q2, umi from reads where cell_id in {_WANTED}")
def tirp_pushed_cells(spark, sf_dir):
    # The filter reaches the source, which passes over the blocks of other cells.
    return readers.read_tirp(spark, *_files(spark, _blocked(spark, sf_dir))).where(f"cell_id in {_WANTED}").select("cell_id", *MATES)


@query(f"{Q.READS}, b as (select case when ordinal % 2 = 0 then 'a_' else 'b_' end || cell_id as cell_id, (row_number() over (partition by ordinal % 2, cell_id order by ordinal) - 1) // {BLOCK_ROWS} as block from reads) select cell_id, cast(count(distinct block) as bigint) as n_blocks, count(*) as n_reads from b group by cell_id")
def merged_blocks(spark, sf_dir):
    # Reads of even and of odd numbers as two libraries, written apart and merged into three files by copying their blocks.
    reads, parts = view(spark, sf_dir, "reads"), []
    for parity, library in enumerate("ab"):
        readers.write_blocks(reads.where(F.col("ordinal") % 2 == parity), part := new_folder(spark, library), library, BLOCK_ROWS)
        parts += _files(spark, part)
    readers.merge_blocks(readers.read_blocks(spark, *parts), path := new_folder(spark, "merged"), 3)
    merged = _files(spark, path)
    blocks = readers.read_blocks(spark, *merged).where("cell_id is not null").groupBy("cell_id").agg(F.count("*").alias("n_blocks"))
    rows = readers.read_tirp(spark, *merged).groupBy("cell_id").agg(F.count("*").alias("n_reads"))
    return blocks.join(rows, "cell_id")


def _bam(spark, sf_dir):
    """Alignments of the view written as BAM, with bases for their length."""
    path = new_folder(spark, "bam")
    readers.write_bam(view(spark, sf_dir, "alignments").select("*", F.expr("repeat('A', l_seq)").alias("seq"), F.lit(None).cast("string").alias("qual")), path)
    return readers.read_bam(spark, *_files(spark, path), split_mb=1 / 8)


@query(f"{Q.ALIGNMENTS} select qname, flag, chrom, pos, end_pos, mapq, l_seq from alignments")
def bam_files(spark, sf_dir):
    return _bam(spark, sf_dir).select("qname", "flag", "chrom", "pos", "end_pos", "mapq", "l_seq")


_REGION = ("chr7", 15_000, 17_000)
_OVER = "chrom = '{}' and pos < {} and end_pos > {}".format(_REGION[0], _REGION[2], _REGION[1])


@query(f"{Q.ALIGNMENTS} select qname, flag, pos, end_pos from alignments where {_OVER}")
def bam_region(spark, sf_dir):
    rows = materialise(_bam(spark, sf_dir).select("file_id", "ordinal", "chrom", "pos", "end_pos"), "rows")
    chunks, windows = (materialise(f(rows), "index") for f in (regions.chunk_index, regions.window_index))
    return regions.read_region(chunks, windows, *_REGION).where("ordinal is not null").select("qname", "flag", "pos", "end_pos")


@query(f"{Q.ALIGNMENTS} select qname, flag, pos, end_pos from alignments where chrom = 'chr9' and pos >= 14000 and pos < 16000")
def bam_pushed_region(spark, sf_dir):
    return _bam(spark, sf_dir).where("chrom = 'chr9' and pos >= 14000 and pos < 16000").select("qname", "flag", "pos", "end_pos")


_BIN = "case " + " ".join(f"when pos >> {s} = (end_pos - 1) >> {s} then {f} + (pos >> {s})" for f, s in regions.LEVELS) + " else 0 end"


@query(f"{Q.ALIGNMENTS} select chrom, {_BIN} as bin, count(*) as n_records from alignments group by all")
def bam_bins(spark, sf_dir):
    return regions.chunk_index(_bam(spark, sf_dir)).groupBy("chrom", "bin").agg(F.sum("n_records").alias("n_records"))


@query(f'{Q.ALIGNMENTS} select chrom, "window", count(distinct qname || flag || pos) as n_records from (select *, unnest(range(pos >> 14, ((end_pos - 1) >> 14) + 1)) as "window" from alignments) group by all')
def bam_windows(spark, sf_dir):
    # Each window's first record is found by its virtual offset, and none of the records over the window stands before it.
    rows = materialise(_bam(spark, sf_dir).select("file_id", "ordinal", "qname", "flag", "chrom", "pos", "end_pos"), "rows")
    windows = filters.small(regions.window_index(rows))
    over = rows.withColumn("window", F.explode(F.sequence(F.shiftright("pos", 14), F.shiftright(F.col("end_pos") - 1, 14))))
    met = over.join(windows, ["file_id", "chrom", "window"]).where("ordinal >= first")
    return met.groupBy("chrom", "window").agg(F.count_distinct(F.concat("qname", F.col("flag").cast("string"), F.col("pos").cast("string"))).alias("n_records"))


_NUMBERED = f"{Q.READS}, n as (select *, row_number() over (partition by cell_id order by ordinal) - 1 as num from reads)"


@query(f"{_NUMBERED} select cell_id || ':' || umi || ':' || num || ' 1' as name, r1 as seq, q1 as qual from n union all select cell_id || ':' || umi || ':' || num || ' 2', r2, q2 from n")
def fastq_files(spark, sf_dir):
    path = new_folder(spark, "fastq")
    readers.write_fastq(view(spark, sf_dir, "reads"), path)
    return readers.read_fastq(spark, *_files(spark, f"{path}/R1"), *_files(spark, f"{path}/R2")).select("name", "seq", "qual")


@query(f"{_NUMBERED} select cell_id, num, umi, r1, r2, q1, q2 from n")
def paired_fastq_files(spark, sf_dir):
    # Pairs of blocked files; mates meet by their number in the file, and names tell the read's number in its cell.
    path = new_folder(spark, "pairs")
    readers.write_paired_fastq(view(spark, sf_dir, "reads"), path)
    first = [p for p in _files(spark, path) if "_R1." in p]
    return readers.read_paired_fastq(spark, *first, split_mb=1 / 8).select("cell_id", "num", "umi", "r1", "r2", "q1", "q2")


@query(f"{Q.READS} select split_part(cell_id, '_', 1) as cell_id, r1, r2, q1, q2 from reads")
def list_fastq_files(spark, sf_dir):
    # The reads of each language in pairs of files of their own, and a list that names them.
    reads = materialise(view(spark, sf_dir, "reads").withColumn("cell_id", F.split_part("cell_id", F.lit("_"), F.lit(1))), "reads")
    rows = []
    for (cell,) in reads.select("cell_id").distinct().sort("cell_id").collect():  # as many as languages
        path = new_folder(spark, "cell")
        readers.write_paired_fastq(reads.where(F.col("cell_id") == cell), path)
        rows += [(cell, p, readers.mate_path(p)) for p in _files(spark, path) if "_R1." in p]
    listed = new_folder(spark, "list")
    spark.createDataFrame(rows, "cell_id string, r1 string, r2 string").write.csv(listed, sep="\t")
    return readers.read_list_fastq(spark, listed).select("cell_id", *MATES[:4])


def _cell_files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.concat(F.lit("d"), F.col("doc_id")).alias("cell_id"), F.lit("contigs.fa").alias("file_name"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))


def _archives(files: DataFrame, least: int) -> int:
    """As many archives as the table is scanned in parts, so that what a task packs does not grow with the table."""
    return max(least, files.rdd.getNumPartitions())


_DIGESTS = "select 'd' || doc_id as cell_id, 'contigs.fa' as file_name, md5(coalesce(text, '')) as digest from documents"


@query(_DIGESTS)
def zip_files(spark, sf_dir):
    path = new_folder(spark, "zip")
    files = _cell_files(spark, sf_dir)
    archives.write_zip(files, path, _archives(files, 8))
    return readers.read_zip(spark, path).select("cell_id", "file_name", F.md5("content").alias("digest"))


@query(f"{_DIGESTS} union all select 'd' || doc_id, 'lang.txt', md5(coalesce(lang, '')) from documents")
def merged_zip(spark, sf_dir):
    # Two sets of archives merged into at least three without unpacking an entry.
    files, parts = _cell_files(spark, sf_dir), []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    other = docs.select(F.concat(F.lit("d"), F.col("doc_id")).alias("cell_id"), F.lit("lang.txt").alias("file_name"), F.encode(F.coalesce("lang", F.lit("")), "utf-8").alias("content"))
    for rows in (files, other):
        archives.write_zip(rows, part := new_folder(spark, "zip"), _archives(rows, 4))
        parts += _files(spark, part)
    listed = spark.createDataFrame([(p,) for p in parts], "archive string")
    archives.merge_zip(archives.list_entries(listed), path := new_folder(spark, "merged"), _archives(files, 3))
    return readers.read_zip(spark, path).select("cell_id", "file_name", F.md5("content").alias("digest"))


@query("select text from documents where doc_id = 7")
def extract_file(spark, sf_dir):
    return readers.extract(_cell_files(spark, sf_dir), "d7", "contigs.fa").select(F.decode("content", "utf-8").alias("text"))


@query("select distinct 'd' || doc_id as cell_id from documents")
def list_cells(spark, sf_dir):
    return readers.list_cells(_cell_files(spark, sf_dir))


@query(f"""{with_views("features")} select gene_id, chrom, start, "end" from features""")
def gff_files(spark, sf_dir):
    lines = view(spark, sf_dir, "features").select(F.concat_ws("\t", "chrom", F.lit("x"), F.lit("gene"), (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("gene_id="), "gene_id", F.lit(";name=n"))))
    return readers.read_features(spark, _written(lines, "features")).select("gene_id", "chrom", "start", "end")


@query(f'{Q.ALIGNMENTS} select chrom, pos as start, end_pos as "end", cell_id as gene_id from alignments where {Q.MAPPED}')
def bed_files(spark, sf_dir):
    path = new_folder(spark, "fragments") + ".bed"
    readers.write_bed(intervals.fragments(view(spark, sf_dir, "alignments")), path)
    return readers.read_features(spark, path).select("chrom", "start", "end", "gene_id")


@query(f"{with_views('whitelist')} select pool, cast(row_number() over (partition by pool order by name, seq) - 1 as int) as idx, name, seq from whitelist")
def whitelist_files(spark, sf_dir):
    path = new_folder(spark, "whitelist")
    view(spark, sf_dir, "whitelist").selectExpr("pool as pos", "name as well", "seq").write.csv(path, sep="\t", header=True)
    return readers.read_whitelist(spark, path)


@query(f"{Q.READS} select cell_id, count(*) as n_reads from reads group by cell_id")
def histogram_files(spark, sf_dir):
    path = new_folder(spark, "histogram")
    readers.write_report(counts.cell_histogram(view(spark, sf_dir, "reads")), path)
    return readers.read_histogram(spark, path)


@query(f"{Q.READS} select cell_id, ordinal, umi from reads where {Q.CELLS}")
def cell_list_files(spark, sf_dir):
    cells = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("lang || '_src3' as cell_id").distinct()
    return filters.include_cells(view(spark, sf_dir, "reads"), readers.read_cell_list(spark, _written(cells, "cells"))).select("cell_id", "ordinal", "umi")


@query(f"with {Q._LIST} select kmer from f")
def kmer_list_files(spark, sf_dir):
    return readers.read_kmer_list(spark, _written(Q._kmer_list(spark, sf_dir), "kmers"))


@query(f"{Q._COUNTED} select kmer, cast(sum(cnt) as bigint) as cnt, 'all' as cell_id from k group by kmer")
def kmer_dump_files(spark, sf_dir):
    path = new_folder(spark, "dump")
    kmers.kmer_union(kmers.kmer_counts(view(spark, sf_dir, "reads"), Q.K)).write.csv(path, sep="\t")
    return readers.read_kmer_dump(spark, path, "all")


@query(f"{Q._MINHASH} select * from m")
def minhash_files(spark, sf_dir):
    # A cell's sketch as its minhash.txt: a line for each of at most HASHES entries.
    lines = F.array_join(F.flatten(F.collect_list(F.expr("array_repeat(kmer, cast(copies as int))"))), "\n")
    files = Q._minhash(spark, sf_dir).groupBy("cell_id").agg(F.encode(lines, "utf-8").alias("content"))
    return readers.read_minhash(files.withColumn("file_name", F.lit("minhash.txt")))


@query(f"{Q.ALIGNMENTS} select qname || chr(9) || flag || chr(9) || chrom || chr(9) || 'CB:Z:' || cell_id || chr(9) || 'UB:Z:' || umi as line from alignments")
def sam_files(spark, sf_dir):
    lines = view(spark, sf_dir, "alignments").select(F.concat_ws("\t", "qname", F.col("flag").cast("string"), "chrom", F.lit("CB:Z:old")))
    return readers.read_sam(spark, _written(lines, "sam")).select(S.sam_tags("line").alias("line"))


@query(f"{Q.READS} select cell_id, r1 || r2 as r1, '' as r2, repeat('F', length(r1) + length(r2)) as q1, '' as q2, '' as umi from reads where length(r1) + length(r2) > 0")
def fasta_reads(spark, sf_dir):
    # Every read pair as a record of two lines.
    files = view(spark, sf_dir, "reads").select("cell_id", F.concat(F.lit(">a b\n"), "r1", F.lit("\n"), "r2", F.lit("\n")).alias("content"))
    return convert.fasta_to_reads(files)


@query(f"{Q.READS} select cell_id, ordinal, cast(case cell_id when 'en_src3' then 0 when 'de_src1' then 1 else 2 end as int) as place from reads where cell_id in ('en_src3', 'de_src1', 'fr_src2')")
def cells_in_order(spark, sf_dir):
    return filters.cells_in_order(view(spark, sf_dir, "reads"), ["en_src3", "de_src1", "fr_src2", "en_src3"]).select("cell_id", "ordinal", "place")


@query("select 'd' || doc_id as cell_id from documents where doc_id % 6 = 0")
def cells_with_files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("'d' || doc_id as cell_id", "doc_id")
    files = docs.where("doc_id % 2 = 0").selectExpr("cell_id", "'a' as file_name").union(docs.where("doc_id % 3 = 0").selectExpr("cell_id", "'b' as file_name"))
    return filters.cells_with_files(files, ["a", "b"])


@query(f"{Q.READS} select cell_id, ordinal, translate(r1, 'ACGTacgt', 'TGCAtgca') as other from reads")
def sorted_complements(spark, sf_dir):
    # The order is asserted before the bases are turned.
    rows = view(spark, sf_dir, "reads").withColumn("file_id", F.expr("ordinal div 1000000"))
    return filters.assert_sorted(rows, "ordinal").select("cell_id", "ordinal", S.complement("r1").alias("other"))


@query("select n_nationkey, 'https://host/x/' || n_name || '/' || n_name || '_genomic.fna.gz' as url from nation")
def genome_urls(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", S.genome_url(F.concat(F.lit("ftp://host/x/"), "n_name", F.lit("/"))).alias("url"))


_MD5 = Q.ORACLE_SQL["countsketch_md5"]


@query(_MD5)
def stream_sketch(spark, sf_dir):
    return streams.run_to_table(streams.sketch_stream(streams.read_stream(spark, sf_dir), Q.K, Q.SKETCH, "md5"))


@query(Q.ORACLE_SQL["minhash_md5"])
def stream_minhash(spark, sf_dir):
    # Four files a trigger; what the last trigger of each cell emitted is its sketch.
    return streams.latest_by_cell(streams.minhash_stream(streams.read_stream(spark, sf_dir), Q.K, Q.HASHES, "md5"))
