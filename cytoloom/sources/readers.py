"""Readers and writers over Spark's own formats, and choosing one by a file's name."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cytoloom.functions import sequence as S
from cytoloom.operators import convert
from cytoloom.operators.filters import small
from cytoloom.operators.layout import coordinate_order, numbered
from cytoloom.scratch import materialise
from cytoloom.sources import archives, formats

#: What a name ends with and what such a file holds.
SUFFIXES = {"tirp": (".tirp", ".tirp.gz"), "zip": (".zip",), "bam": (".bam", ".cram"), "list_fastq": (".listfastq",), "paired_fastq": (".R1.fastq.gz", ".R1.fq.gz", ".R1.fastq", ".R1.fq", "_R1.fastq.gz", "_R1.fq.gz"), "single_fastq": (".fastq.gz", ".fq.gz", ".fastq", ".fq")}


def detect_format(path: str) -> str:
    return next((kind for kind, ends in SUFFIXES.items() if path.endswith(ends)), "other")


def mate_path(path: str) -> str:
    """The file of second mates beside one of first mates."""
    for sign in (".R1.", "_R1."):
        head, found, tail = path.rpartition(sign)
        if found:
            return f"{head}{sign.replace('1', '2')}{tail}"
    raise ValueError(f"{path} does not name a file of first mates")


def read_fastq(spark: SparkSession, *paths: str, split_mb: float = 64) -> DataFrame:
    formats.register(spark)
    return spark.read.format("fastq").option("split_mb", split_mb).load(",".join(paths))


def pair_mates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates of two FASTQ tables by their number in the file, ``num`` if they have it; a read without a mate is left out."""
    a, b = (rows if "num" in rows.columns else numbered(rows, ["ordinal"], ["file_id"]).drop("ordinal") for rows in (first, second))
    b = b.withColumn("file_id", F.regexp_replace("file_id", r"([._])R2([._])", "$1R1$2"))
    met = a.alias("a").join(b.alias("b"), ["file_id", "num"])
    return met.select("file_id", F.col("num").alias("ordinal"), F.col("a.name").alias("name"), F.col("a.seq").alias("r1"), F.col("b.seq").alias("r2"), F.col("a.qual").alias("q1"), F.col("b.qual").alias("q2"))


def read_paired_fastq(spark: SparkSession, *paths: str, split_mb: float = 64) -> DataFrame:
    """Reads of pairs of files, named by those of the first mates, whose read names are cell:umi:number.

    ``num`` is the number in the name; null if there is none.
    """
    number = F.split_part(F.split_part("name", F.lit(" "), F.lit(1)), F.lit(":"), F.lit(3)).try_cast("long")
    mates = [*map(mate_path, paths)]
    split = formats.grown(int(split_mb * (1 << 20)), sum(map(formats.size_of, [*paths, *mates]))) / (1 << 20)
    first, second = (numbered_records(spark.createDataFrame([(p,) for p in side], "file_id string"), split) for side in (paths, mates))
    pairs = pair_mates(first, second)
    return pairs.select("file_id", "ordinal", S.qname_cell("name").alias("cell_id"), "r1", "r2", "q1", "q2", S.qname_umi("name").alias("umi"), number.alias("num"))


def file_ranges(files: DataFrame, split_mb: float = 64) -> DataFrame:
    """(file_id, start, end, kind) for a table of file_id: ranges of each file, planned in the tasks that hold its row."""
    split = int(split_mb * (1 << 20))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r.path, r.start, r.end, r.kind) for path in batch.column("file_id").to_pylist() for r in formats.ranges_of(path, split)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["file_id", "start", "end", "kind"])

    cores = files.sparkSession.sparkContext.defaultParallelism
    ranges = files.select("file_id").distinct().mapInArrow(plan, "file_id string, start long, end long, kind string")
    return ranges.repartition(max(cores, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file_id", "start")


def numbered_records(files: DataFrame, split_mb: float = 64) -> DataFrame:
    """(file_id, num, name, seq, qual): the records of FASTQ files with their number in the file, from 0.

    A record's number is its number in the range it is read in after all records of the ranges before, so nothing is sorted.
    """
    schema = pa.schema([("file_id", pa.string()), ("start", pa.int64()), ("at", pa.int64()), *list(formats.FASTQ_ROWS)[2:]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                part = formats.Range(r["file_id"], r["start"], r["end"], r["kind"])
                yield from formats.batches(((part.path, part.start, i, *x[1:]) for i, x in enumerate(formats.fastq_records(part))), schema)

    rows = materialise(file_ranges(files, split_mb).mapInArrow(read, "file_id string, start long, at long, name string, seq string, qual string"), "records")
    ranges = rows.groupBy("file_id", "start").agg(F.count("*").alias("n"))
    ahead = small(ranges.select("file_id", "start", (F.sum("n").over(W.partitionBy("file_id").orderBy("start")) - F.col("n")).alias("ahead")))
    return rows.join(ahead, ["file_id", "start"]).select("file_id", (F.col("at") + F.col("ahead")).alias("num"), "name", "seq", "qual")


def read_list_fastq(spark: SparkSession, path: str, split_mb: float = 64) -> DataFrame:
    """A table of name, r1 and r2: each pair of files is one cell without UMIs.

    The list stays a table: tasks plan ranges of the files it names, others read them, and mates meet by their number.
    """
    listed = materialise(spark.read.csv(path, sep="\t", schema="cell_id string, r1 string, r2 string"), "list")
    rows = numbered_records(listed.select(F.explode(F.array("r1", "r2")).alias("file_id")), split_mb)
    side = lambda mate: small(listed.select("cell_id", "r1", F.col(f"r{mate}").alias("file_id"))).join(rows, "file_id").select("cell_id", F.col("r1").alias("file"), "num", F.col("seq").alias(f"s{mate}"), F.col("qual").alias(f"q{mate}"))
    met = side(1).join(side(2), ["cell_id", "file", "num"])
    return met.select(F.col("file").alias("file_id"), F.col("num").alias("ordinal"), "cell_id", F.col("s1").alias("r1"), F.col("s2").alias("r2"), "q1", "q2", F.lit("").alias("umi"))


def read_tirp(spark: SparkSession, *paths: str, split_mb: float = 64) -> DataFrame:
    formats.register(spark)
    return spark.read.format("tirp").option("split_mb", split_mb).load(",".join(paths))


def read_bam(spark: SparkSession, *paths: str, split_mb: float = 64) -> DataFrame:
    formats.register(spark)
    return spark.read.format("bam").option("split_mb", split_mb).load(",".join(paths))


def read_blocks(spark: SparkSession, *paths: str, split_mb: float = 64) -> DataFrame:
    formats.register(spark)
    return spark.read.format("gzipblocks").option("split_mb", split_mb).load(",".join(paths))


def cell_index(blocks: DataFrame) -> DataFrame:
    """(file_id, cell_id, begin, end, n_blocks): where the named blocks of each cell stand in each file.

    In a file that is sorted by cell these are runs; in another one blocks of other cells may stand between.
    """
    named = blocks.where("cell_id is not null")
    return named.groupBy("file_id", "cell_id").agg(F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("size")).alias("end"), F.count("*").alias("n_blocks"))


def read_cells(index: DataFrame, cells: DataFrame, split_mb: float = 64) -> DataFrame:
    """The reads of the listed cells with ``n_blocks``, from the blocks that an index of cells points to.

    Long runs are cut into pieces, so a cell of any size is read by many tasks, and nothing else is inflated.  A row
    whose ``ordinal`` is null counts in ``n_blocks`` how many blocks its piece has inflated; ``n_blocks`` of a read is 0.
    """
    split = int(split_mb * (1 << 20))
    wanted = index.join(small(cells.where("cell_id <> ''").select("cell_id").distinct()), "cell_id", "left_semi")
    pieces = wanted.withColumn("start", F.explode(F.sequence("begin", F.col("end") - 1, F.lit(split)))).select("file_id", "cell_id", "start", F.least(F.col("start") + split, "end").alias("stop"), (F.col("start") == F.col("begin")).alias("first"))
    cores = index.sparkSession.sparkContext.defaultParallelism
    schema = formats.TIRP_ROWS.append(pa.field("n_blocks", pa.int64()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                opened = [0]
                yield from formats.batches(((*x, 0) for x in formats.cell_records(r["file_id"], r["cell_id"], r["start"], r["stop"], r["first"], opened)), schema)
                yield from formats.batches(iter([(r["file_id"], None, r["cell_id"], None, None, None, None, None, opened[0])]), schema)

    return pieces.repartition(cores, "file_id", "start").mapInArrow(read, f"{formats.TIRP}, n_blocks long")


def merge_blocks(blocks: DataFrame, path: str, files: int) -> None:
    """Blocks of many files in about ``files`` files, sorted by cell; they are copied as they are, none is inflated.

    Ranges are of equal numbers of blocks, so the blocks of a large cell may go to several files, one after the other.
    """
    named = blocks.where("cell_id is not null")
    named.repartitionByRange(files, "cell_id", "file_id", "offset").sortWithinPartitions("cell_id", "file_id", "offset").select("file_id", "offset", "size", "cell_id").write.format("gzipblocks").mode("append").save(path)


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """(cell_id, file_name, content) of archives whose entries are cell/file; ``path`` is a folder, a pattern or a file."""
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"))
    return archives.read_entries(archives.list_entries(listed))


def read_features(spark: SparkSession, path: str, kind: str = "gene", id_key: str = "gene_id", name_key: str = "name") -> DataFrame:
    """Features of a GFF, GTF or BED file, 0-based and half open; an error if there are none.  Lines that begin with # are skipped."""
    if path.removesuffix(".gz").endswith(".bed"):
        bed = spark.read.csv(path, sep="\t", comment="#", schema="chrom string, start long, end long, gene_id string")
        out = bed.select(F.coalesce("gene_id", F.concat_ws("_", "chrom", "start", "end")).alias("gene_id"), F.col("chrom").alias("gene_name"), "chrom", "start", "end", F.lit(".").alias("strand"))
    else:
        rows = spark.read.csv(path, sep="\t", comment="#", quote="", schema="chrom string, source string, kind string, start long, end long, score string, strand string, phase string, attributes string").where(F.col("kind") == kind)
        attribute = lambda key: F.nullif(F.regexp_extract("attributes", rf'(?:^|;)\s*{key}[= ]"?([^";]+)', 1), F.lit(""))
        out = rows.select(attribute(id_key).alias("gene_id"), F.coalesce(attribute(name_key), attribute(id_key)).alias("gene_name"), "chrom", (F.col("start") - 1).alias("start"), "end", "strand").where("gene_id is not null")
    if out.isEmpty():
        raise ValueError(f"{path} has no feature of type {kind}")
    return out


def read_cell_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("cell_id")).where("cell_id <> ''")


def read_kmer_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("kmer")).where("kmer <> ''").distinct()


def read_kmer_dump(spark: SparkSession, path: str, cell_id: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="kmer string, cnt long").withColumn("cell_id", F.lit(cell_id))


def read_minhash(files: DataFrame) -> DataFrame:
    """(cell_id, kmer, copies) from the minhash.txt of each cell: the first column of each line."""
    lines = files.where("file_name = 'minhash.txt'").select("cell_id", F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).where("line <> ''")
    return lines.groupBy("cell_id", F.split_part("line", F.lit("\t"), F.lit(1)).alias("kmer")).agg(F.count("*").alias("copies"))


def read_whitelist(spark: SparkSession, path: str, layout: str = "wells") -> DataFrame:
    """Barcodes: ``wells`` is a table pos, well, seq with a header; ``kit`` is CSV with sequence, uid and well; ``plain`` has one a line."""
    if layout == "wells":
        rows = spark.read.csv(path, sep="\t", header=True).select(F.col("pos").cast("int").alias("pool"), F.col("well").alias("name"), "seq")
    elif layout == "kit":
        rows = spark.read.csv(path, header=True).select(F.lit(0).alias("pool"), F.col("well").alias("name"), F.col("sequence").alias("seq"))
    else:
        rows = spark.read.text(path).select(F.lit(0).alias("pool"), F.trim("value").alias("name"), F.trim("value").alias("seq"))
    ranked = numbered(rows, ["name", "seq"], ["pool"], "idx")
    return ranked.select("pool", F.col("idx").cast("int").alias("idx"), "name", "seq")


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema="cell_id string, n_reads long")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """The table of a file by its name; FASTQ without a mate is read as it is."""
    kind = detect_format(path)
    readers = {"tirp": read_tirp, "zip": read_zip, "bam": read_bam, "paired_fastq": read_paired_fastq, "single_fastq": read_fastq, "list_fastq": read_list_fastq}
    if kind not in readers:
        raise ValueError(f"{path}: unknown kind of file")
    return readers[kind](spark, path)


def write_tirp(reads: DataFrame, path: str, library: str = "", shards: int | None = None) -> None:
    """Gzip text files of read lines sorted by cell; the rows of a cell stay in one range of files."""
    lines = convert.to_tirp(reads, library)
    ranged = lines.repartitionByRange(shards, "cell_id") if shards else lines.repartitionByRange("cell_id")
    ranged.sortWithinPartitions("cell_id", "value").select("value").write.option("compression", "gzip").text(path)


def write_blocks(reads: DataFrame, path: str, library: str = "", block_rows: int = 100, order: str = "ordinal") -> None:
    """Reads sorted by cell as blocked gzip; each block holds at most ``block_rows`` reads of one cell and its name.

    Ranges are cut between blocks, so a cell of any size is written by many tasks.
    """
    formats.register(reads.sparkSession)
    rows = numbered(reads, [order], ["cell_id"])
    value = convert.tirp_line(library)
    lines = rows.select(convert.library_cell(library).alias("cell_id"), F.floor(F.col("num") / block_rows).alias("block"), "num", value.alias("value"))
    lines.repartitionByRange("cell_id", "block").sortWithinPartitions("cell_id", "num").select("cell_id", "block", "value").write.format("tirp").mode("append").save(path)


def write_fastq(reads: DataFrame, path: str, order: str = "ordinal") -> None:
    """Folders R1 and R2 of FASTQ files with mates in the same order."""
    rows = materialise(convert.to_fastq(reads, order).repartitionByRange("cell_id", "num"), "fastq")
    for mate in (1, 2):
        rows.sortWithinPartitions("cell_id", "num").select(F.col(f"r{mate}_fastq").alias("value")).write.option("compression", "gzip").text(f"{path}/R{mate}")


def write_paired_fastq(reads: DataFrame, path: str, order: str = "ordinal") -> None:
    """Pairs of blocked files, _R1.fastq.gz and _R2.fastq.gz, sorted by cell; each pair holds a range of the reads."""
    formats.register(reads.sparkSession)
    rows = convert.to_fastq(reads, order).repartitionByRange("cell_id", "num").sortWithinPartitions("cell_id", "num")
    rows.select("r1_fastq", "r2_fastq").write.format("fastq").mode("append").save(path)


def write_bed(fragments: DataFrame, path: str) -> None:
    fragments.select("chrom", "start", "end", "cell_id", "cnt", "umi").sort("chrom", "start", "end", "cell_id").write.option("emptyValue", "").csv(path, sep="\t", compression="gzip")


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, sep="\t", header=True)


def write_matrix(counts: DataFrame, obs: DataFrame, path: str) -> None:
    """A sparse matrix as Parquet tables: counts by name, and one row of facts for each cell."""
    counts.write.parquet(f"{path}/counts")
    obs.write.parquet(f"{path}/obs")


def write_sketches(matrix: DataFrame, path: str, size: int) -> None:
    """Sketches as a wide Parquet table: cell_id, depth and one column for each place."""
    matrix.select("cell_id", "depth", *[F.col("sketch")[i].alias(f"cs_{i}") for i in range(size)]).write.parquet(path)


def write_alignments(alignments: DataFrame, path: str) -> None:
    """Alignments in coordinate order as Parquet."""
    coordinate_order(alignments).write.parquet(path)


def write_bam(alignments: DataFrame, path: str, references: DataFrame | None = None) -> None:
    """BAM files in coordinate order; each holds a range of places.

    Without ``references`` (name, length) the header lists the names that occur, in order, each as long as its
    alignments reach; as many as there are reference sequences come to the driver.
    """
    formats.register(alignments.sparkSession)
    if references is None:
        references = alignments.where("chrom is not null").groupBy(F.col("chrom").alias("name")).agg(F.max("end_pos").alias("length"))
    listed = [[r["name"], int(r["length"])] for r in references.select("name", "length").sort("name").collect()]
    coordinate_order(alignments).select("qname", "flag", "chrom", "pos", "end_pos", "mapq", "cigar", "seq", "qual").write.format("bam").option("references", json.dumps(listed)).mode("append").save(path)


def extract(files: DataFrame, cell_id: str, file_name: str) -> DataFrame:
    return files.where((F.col("cell_id") == cell_id) & (F.col("file_name") == file_name)).select("content")


def list_cells(files: DataFrame) -> DataFrame:
    return files.select("cell_id").distinct()
