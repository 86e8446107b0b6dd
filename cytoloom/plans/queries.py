"""One registered query for each operator over the driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cytoloom.functions import sequence as S
from cytoloom.operators import assembly, barcodes, convert, counts, features, filters, intervals, kmers, layout, mapcell, umis
from cytoloom.plans.views import view, with_views
from cytoloom.scratch import materialise

K, SKETCH, HASHES = 11, 256, 50
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


READS, ALIGNMENTS = with_views("reads"), with_views("alignments")
MAPPED = "flag & 4 = 0"
MATCHED = "m_len + case when spliced then 10 else 0 end"
#: All windows of both mates, as (cell_id, kmer).
WINDOWS = f"w as (select cell_id, unnest(list_transform(range(1, length(r) - {K} + 2), lambda i: substr(r, i, {K}))) as kmer from (select cell_id, r1 as r from reads union all select cell_id, r2 from reads))"
RC = "reverse(translate(kmer, 'ACGT', 'TGCA'))"


@query(f"{READS} select cell_id, count(*) as n_reads from reads group by cell_id")
def cell_histogram(spark, sf_dir):
    return counts.cell_histogram(view(spark, sf_dir, "reads"))


@query(f"{READS} select cell_id, r1, r2 from reads")
def project_records(spark, sf_dir):
    return view(spark, sf_dir, "reads").select("cell_id", "r1", "r2")


CELLS = "cell_id in (select lang || '_src3' from documents)"


@query(f"{READS} select cell_id, ordinal, umi from reads where {CELLS}")
def filter_cells_semi(spark, sf_dir):
    cells = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("lang || '_src3' as cell_id").distinct()
    return filters.include_cells(view(spark, sf_dir, "reads"), cells).select("cell_id", "ordinal", "umi")


_PAIRS = f"""{ALIGNMENTS}, o as (
    select *, {MAPPED} and ({MATCHED}) * 100 >= l_seq * 60 as ok, flag & 64 <> 0 as is_first, flag & 128 <> 0 as is_last from alignments
), n as (
    select *, lead(is_last) over w as next_last, lead(ok) over w as next_ok, lag(is_first) over w as before_first, lag(ok) over w as before_ok
    from o window w as (partition by file_id, qname order by ordinal)
), p as (
    select *, ok or coalesce(case when is_first and next_last then next_ok when is_last and before_first then before_ok end, false) as passed from n
) select ordinal, qname, flag from p where """


@query(_PAIRS + "passed")
def filter_mapped(spark, sf_dir):
    return filters.split_mapped(view(spark, sf_dir, "alignments"), percent=60).select("ordinal", "qname", "flag")


@query(_PAIRS + "not passed")
def filter_unmapped(spark, sf_dir):
    return filters.split_mapped(view(spark, sf_dir, "alignments"), percent=60, keep_unmapped=True).select("ordinal", "qname", "flag")


@query(f"{ALIGNMENTS} select ordinal, mapq, flag from alignments where flag & 2304 = 0 and coalesce(mapq, 0) > 0")
def filter_multimapper(spark, sf_dir):
    return filters.unique_mappers(view(spark, sf_dir, "alignments")).select("ordinal", "mapq", "flag")


@query(f"{ALIGNMENTS} select ordinal, chrom, pos from alignments where chrom is not null and pos >= 0 and flag & 260 = 0")
def filter_track(spark, sf_dir):
    return filters.track_records(view(spark, sf_dir, "alignments"), skip_secondary=True).select("ordinal", "chrom", "pos")


@query(f"{ALIGNMENTS} select cell_id, chrom, count(*) as n_reads from (select cell_id, case when {MAPPED} and {MATCHED} >= 20 then chrom end as chrom from alignments where flag & 2304 = 0 and coalesce(mapq, 0) > 0) group by all")
def count_chrom(spark, sf_dir):
    return counts.count_chrom(view(spark, sf_dir, "alignments"), remove_multimappers=True, min_matching=20)


@query(f"""{ALIGNMENTS}, g as (select *, case when {MAPPED} then chrom end as c from alignments),
    d as (select cell_id, c, pos, lag(pos) over (partition by file_id, cell_id, c order by ordinal) as before from g where c is not null)
    select cell_id, c as chrom, count(*) as n_reads from (select cell_id, c from d where before is distinct from pos union all select cell_id, c from g where c is null) group by all""")
def count_chrom_dedup(spark, sf_dir):
    return counts.count_chrom(view(spark, sf_dir, "alignments"), remove_duplicates=True)


@query(f"{ALIGNMENTS} select cell_id, chrom, count(*) as n_reads from alignments where {MAPPED} group by all")
def ref_composition(spark, sf_dir):
    return counts.ref_composition(view(spark, sf_dir, "alignments"))


_RUNS = f"""{ALIGNMENTS}, e as (select cell_id, chrom, pos as place, 1 as d from alignments where {MAPPED} and end_pos > pos union all select cell_id, chrom, end_pos, -1 from alignments where {MAPPED} and end_pos > pos),
    s as (select cell_id, chrom, place, sum(d) as d from e group by cell_id, chrom, place having sum(d) <> 0),
    r as (select cell_id, chrom, place as start, cast(sum(d) over w as bigint) as depth, lead(place) over w - place as len from s window w as (partition by cell_id, chrom order by place)), runs as (select * from r where depth > 0)"""


@query(f"{_RUNS} select cell_id, chrom, start, len, depth from runs")
def depth_runs(spark, sf_dir):
    return intervals.depth_runs(view(spark, sf_dir, "alignments"))


@query(f"""{_RUNS}, t as (select cell_id, chrom, cast(sum(end_pos - pos) as bigint) as sumof_aligned_bases, count(*) as countof_alignments from alignments where {MAPPED} group by all)
    select t.*, cast(coalesce(u.n, 0) as bigint) as union_aligned_bases from t left join (select cell_id, chrom, sum(len) as n from runs group by all) u using (cell_id, chrom)""")
def aligned_coverage(spark, sf_dir):
    return intervals.aligned_coverage(view(spark, sf_dir, "alignments"))


@query(f"{_RUNS} select cell_id, chrom, string_agg(start || ':' || depth || ':' || len, ',' order by start) as rle from runs group by all")
def coverage_rle(spark, sf_dir):
    return intervals.coverage_rle(view(spark, sf_dir, "alignments"))


@query(f"""{ALIGNMENTS}, b as (select chrom, pos as s, pos + m_len as e from alignments where {MAPPED} union all select chrom, pos + m_len + 20, pos + m_len + 30 from alignments where {MAPPED} and spliced),
    x as (select chrom, s, e, unnest(range(s // 50, (e - 1) // 50 + 1)) as bin from b), c as (select chrom, bin, sum(least(e, (bin + 1) * 50) - greatest(s, bin * 50)) as bases from x group by all),
    n as (select *, case when lag(bin) over w = bin - 1 and lag(bases) over w = bases then 0 else 1 end as new from c window w as (partition by chrom order by bin)),
    g as (select *, sum(new) over (partition by chrom order by bin) as run from n)
    select chrom, min(bin) * 50 as start, (max(bin) + 1) * 50 as "end", cast(bases as bigint) as bases from g group by chrom, run, bases""")
def binned_coverage(spark, sf_dir):
    return intervals.binned_coverage(filters.track_records(view(spark, sf_dir, "alignments")))


@query(f"{ALIGNMENTS} select chrom, pos as start, end_pos as \"end\", cell_id, 1 as cnt, '' as umi from alignments where {MAPPED}")
def fragments(spark, sf_dir):
    return intervals.fragments(view(spark, sf_dir, "alignments"))


_OVERLAPS = f"""{with_views("alignments", "features")}, u as (select gene_id, cell_id, umi, count(*) as cnt from alignments a join features f on a.chrom = f.chrom and a.pos < f."end" and f.start < a.end_pos where {MAPPED} group by all)"""
_CODES = f"""c as (select *, cast(list_reduce(list_transform(string_split(umi, ''), lambda x: cast(position(x in 'ATGC') - 1 as bigint)), lambda a, b: a * 4 + b) as bigint) as code from u)"""


@query(f"{_OVERLAPS} select gene_id, cell_id, cast(sum(cnt) as bigint) as n_reads from u group by all")
def count_feature_reads(spark, sf_dir):
    return features.feature_reads(view(spark, sf_dir, "alignments"), view(spark, sf_dir, "features"))


@query(f"""{_OVERLAPS}, {_CODES} select gene_id, cell_id, count(*) as n_umis from c where not exists (select 1 from c d where d.gene_id = c.gene_id and d.cell_id = c.cell_id and (d.cnt, d.code) > (c.cnt, c.code) and bit_count(xor(c.code, d.code)) <= 1) group by all""")
def count_feature_umi(spark, sf_dir):
    return features.feature_molecules(view(spark, sf_dir, "alignments"), view(spark, sf_dir, "features"))


_CHROM_UMIS = f"{ALIGNMENTS}, u as (select chrom, umi, count(*) as cnt from alignments where {MAPPED} group by all)"


def _chrom_umis(spark, sf_dir):
    return view(spark, sf_dir, "alignments").where("flag & 4 = 0").groupBy("chrom", "umi").agg(F.count("*").alias("cnt"))


@query(f"{_CHROM_UMIS} select chrom, count(distinct umi) as n_umis from u group by all")
def umi_exact(spark, sf_dir):
    return umis.exact_umis(_chrom_umis(spark, sf_dir), ["chrom"])


@query(f"{_CHROM_UMIS}, {_CODES}, bits as (select 1 << b as bit from range(0, 16) t(b)), gone as (select distinct c.chrom, c.code from c, bits, c d where d.chrom = c.chrom and d.code = xor(c.code, bit) and (d.cnt, d.code) > (c.cnt, c.code)) select chrom, count(*) as n_umis from c anti join gone using (chrom, code) group by all")
def umi_directional(spark, sf_dir):
    return umis.directional_umis(_chrom_umis(spark, sf_dir), ["chrom"])


_COUNTED = f"{READS}, {WINDOWS}, k as (select cell_id, least(kmer, {RC}) as kmer, count(*) as cnt from w where not contains(kmer, 'N') group by all)"


@query(f"{_COUNTED} select * from k")
def kmer_counts(spark, sf_dir):
    return kmers.kmer_counts(view(spark, sf_dir, "reads"), K)


@query(f"{_COUNTED} select kmer, cast(sum(cnt) as bigint) as cnt from k group by kmer")
def kmer_union(spark, sf_dir):
    return kmers.kmer_union(kmers.kmer_counts(view(spark, sf_dir, "reads"), K))


def _kmer_list(spark, sf_dir):
    text = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr(f"translate(regexp_replace(lower(text), '[^a-z]', 'n'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTANGTACGTACGTAC') as s")
    return text.select(F.explode(S.kmers("s", K)).alias("kmer"))


_LIST = f"f as (select distinct unnest(list_transform(range(1, length(s) - {K} + 2), lambda i: substr(s, i, {K}))) as kmer from (select translate(regexp_replace(lower(text), '[^a-z]', 'n', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTANGTACGTACGTAC') as s from benchmark))"


@query(f"{READS}, {WINDOWS}, {_LIST}, b as (select cell_id, kmer from w union all select cell_id, {RC} from w) select cell_id, kmer as feature, count(*) as cnt from b semi join f using (kmer) group by all")
def kmer_feature_counts(spark, sf_dir):
    return kmers.feature_counts(view(spark, sf_dir, "reads"), _kmer_list(spark, sf_dir), K)


@query(f"{_COUNTED}, {_LIST} select cell_id, kmer as feature, cnt from k semi join f using (kmer)")
def kmer_dump_lookup(spark, sf_dir):
    return kmers.dump_lookup(kmers.kmer_counts(view(spark, sf_dir, "reads"), K), _kmer_list(spark, sf_dir))


_MINHASH = f"""{READS}, {WINDOWS}, c as (select cell_id, kmer, count(*) as cnt from w group by all),
    r as (select *, sum(cnt) over (partition by cell_id order by md5(kmer), kmer rows unbounded preceding) - cnt as before from c),
    m as (select cell_id, kmer, cast(least(cnt, {HASHES} - before) as bigint) as copies from r where before < {HASHES})"""


def _minhash(spark, sf_dir):
    return kmers.minhash(view(spark, sf_dir, "reads"), K, HASHES, "md5")


@query(f"{_MINHASH} select * from m")
def minhash_md5(spark, sf_dir):
    return _minhash(spark, sf_dir)


@query(f"{_MINHASH} select kmer, cast(sum(copies) as bigint) as cnt from m group by kmer")
def minhash_hist(spark, sf_dir):
    return kmers.minhash_histogram(_minhash(spark, sf_dir))


@query()
def minhash_xxhash64(spark, sf_dir):
    return kmers.minhash(view(spark, sf_dir, "reads"), K, HASHES)


@query(f"""{READS}, {WINDOWS}, h as (select cell_id, cast('0x' || substr(md5(least(kmer, {RC})), 1, 15) as bigint) as h from w)
    select cell_id, h & {SKETCH - 1} as pos, cast(sum(case when (h >> 32) & 1 = 0 then 1 else -1 end) as bigint) as val from h group by all having val <> 0""")
def countsketch_md5(spark, sf_dir):
    return kmers.count_sketch(view(spark, sf_dir, "reads"), K, SKETCH, "md5")


@query()
def countsketch_xxhash64(spark, sf_dir):
    return kmers.count_sketch(view(spark, sf_dir, "reads"), K, SKETCH)


@query(f"{READS} select cell_id, cast(sum(greatest(length(r1) - {K - 1}, 0) + greatest(length(r2) - {K - 1}, 0)) as bigint) as depth, cast(sum((length(r1) < {K})::int + (length(r2) < {K})::int) as bigint) as skipped from reads group by cell_id")
def sketch_depth(spark, sf_dir):
    return kmers.sketch_depth(view(spark, sf_dir, "reads"), K)


_TAGS = with_views("tags", "whitelist")
_HAMMING = "list_sum(list_transform(range(1, 9), lambda i: case when substr(tag, i, 1) = substr(seq, i, 1) and substr(tag, i, 1) <> 'N' then 0 else 1 end))"


def _nearest(most: int) -> str:
    return f"""{_TAGS}, d as (select tag, name, idx, cast({_HAMMING} as int) as distance from (select distinct tag from tags), whitelist), b as (select * from d where distance <= {most} qualify row_number() over (partition by tag order by distance, idx) = 1)
        select ordinal, tag, name, idx, distance from tags left join b using (tag)"""


@query(f"{_TAGS} select ordinal, tag, name, idx, case when name is not null then 0 end as distance from tags left join whitelist on tag = seq")
def barcode_exact(spark, sf_dir):
    return barcodes.nearest_barcode(view(spark, sf_dir, "tags"), view(spark, sf_dir, "whitelist"), 0)


@query(_nearest(1))
def barcode_hamming1(spark, sf_dir):
    return barcodes.nearest_barcode(view(spark, sf_dir, "tags"), view(spark, sf_dir, "whitelist"), 1)


@query(f"""{_TAGS}, d as (select tag, name, idx, cast(levenshtein(tag, seq) as int) as distance from (select distinct tag from tags), whitelist), b as (select * from d where distance <= 2 qualify row_number() over (partition by tag order by distance, idx) = 1)
    select ordinal, tag, name, idx, distance from tags left join b using (tag)""")
def barcode_edit_distance(spark, sf_dir):
    return barcodes.edit_distance_barcode(view(spark, sf_dir, "tags"), view(spark, sf_dir, "whitelist"), 2)


@query(f"{_TAGS}, v as (select 'exact' as kit, count(*) filter (tag in (select seq from whitelist)) / count(*) as share from tags union all select 'reversed', count(*) filter (reverse(tag) in (select seq from whitelist)) / count(*) from tags) select kit, share from v order by share desc, kit limit 1")
def chemistry_vote(spark, sf_dir):
    tags, wl = view(spark, sf_dir, "tags"), filters.small(view(spark, sf_dir, "whitelist").select("seq", F.lit(True).alias("hit")))
    both = tags.select(F.lit("exact").alias("kit"), "tag").unionByName(tags.select(F.lit("reversed").alias("kit"), F.reverse("tag").alias("tag")))
    return counts.chemistry_vote(both.join(wl, F.col("tag") == F.col("seq"), "left").select("kit", F.coalesce("hit", F.lit(False)).alias("matched")))


@query(f"{READS} select ordinal, cell_id, cast(('0x' || substr(md5(cell_id), 1, 8))::bigint % 7 as int) as shard from reads")
def shard_assignment(spark, sf_dir):
    hashed = F.conv(F.substr(F.md5("cell_id"), F.lit(1), F.lit(8)), 16, 10).cast("long")
    return view(spark, sf_dir, "reads").select("ordinal", "cell_id", layout.shard_of("cell_id", 7, hashed).alias("shard"))


@query(f"{READS} select '0' as file_id, cell_id, ordinal, true as sorted from reads where ordinal % 2 = 0 union all select '1', cell_id, ordinal, true from reads where ordinal % 2 = 1")
def kway_merge(spark, sf_dir):
    # A row tells whether its cell is not before that of the row ahead of it in its partition, as it is written.
    reads = view(spark, sf_dir, "reads")
    merged = layout.merge_sorted([reads.where("ordinal % 2 = 0"), reads.where("ordinal % 2 = 1")], 4).select("file_id", "cell_id", "ordinal", "shard")
    placed = materialise(merged.withColumn("_id", F.monotonically_increasing_id()), "merged")
    before = F.lag("cell_id").over(Window.partitionBy("shard").orderBy("_id"))
    return placed.select("file_id", "cell_id", "ordinal", (before.isNull() | (before <= F.col("cell_id"))).alias("sorted"))


@query(f"{ALIGNMENTS} select file_id, ordinal, row_number() over (order by chrom, pos, (flag & 16 <> 0)::int, file_id, ordinal) as rank from alignments")
def coord_sort_rank(spark, sf_dir):
    return layout.coordinate_rank(view(spark, sf_dir, "alignments"))


_SIZES = assembly.THRESHOLDS
_STATS = ", ".join([f"cast(count(*) filter (len >= {t}) as bigint) as contigs_{t}, cast(coalesce(sum(len) filter (len >= {t}), 0) as bigint) as total_{t}" for t in _SIZES])


@query(f"""{with_views("contigs")}, c as (select cell_id, length(seq) as len, length(seq) - length(translate(seq, 'GC', '')) as gc, length(seq) - length(translate(seq, 'ACGT', '')) as acgt, length(seq) - length(translate(seq, 'N', '')) as ns from contigs),
    k as (select * from c where len >= 500),
    a as (select cell_id, {_STATS}, cast(count(*) filter (len >= 500) as bigint) as contigs, max(len) filter (len >= 500) as largest, cast(coalesce(sum(len) filter (len >= 500), 0) as bigint) as total, cast(coalesce(sum(ns) filter (len >= 500), 0) as bigint) as n_bases,
        round(sum(len * len) filter (len >= 500) / sum(len) filter (len >= 500), 6) as aun, round(sum(gc) filter (len >= 500) * 100 / sum(acgt) filter (len >= 500), 6) as gc_percent, round(sum(ns) filter (len >= 500) * 100000 / sum(len) filter (len >= 500), 6) as ns_per_100kbp from c group by cell_id),
    r as (select cell_id, len, sum(len) over (partition by cell_id order by len desc rows unbounded preceding) as upto, sum(len) over (partition by cell_id) as total, row_number() over (partition by cell_id order by len desc) as place from k),
    n as (select cell_id, max(len) filter (upto * 2 >= total) as n50, max(len) filter (upto * 10 >= total * 9) as n90, min(place) filter (upto * 2 >= total) as l50, min(place) filter (upto * 10 >= total * 9) as l90 from r group by cell_id)
    select * from a left join n using (cell_id)""")
def assembly_stats(spark, sf_dir):
    return assembly.assembly_stats(assembly.contigs_of(view(spark, sf_dir, "contigs")))


@query(f"{READS} select cell_id, ordinal from reads qualify row_number() over (partition by cell_id order by ordinal) <= 20")
def first_n_per_cell(spark, sf_dir):
    return filters.first_per_cell(view(spark, sf_dir, "reads").select("cell_id", "ordinal"), 20)


def _fastq(mate: int) -> str:
    return f"'@' || cell_id || ':' || umi || ':' || num || ' {mate}' || chr(10) || r{mate} || chr(10) || '+' || chr(10) || q{mate} as r{mate}_fastq"


@query(f"{READS}, n as (select *, row_number() over (partition by cell_id order by ordinal) - 1 as num from reads) select cell_id, num, {_fastq(1)}, {_fastq(2)} from n")
def tirp_to_fastq(spark, sf_dir):
    return convert.to_fastq(view(spark, sf_dir, "reads"))


@query(f"{READS} select cell_id, 'lib_' || cell_id || chr(9) || '1' || chr(9) || '1' || chr(9) || r1 || chr(9) || r2 || chr(9) || q1 || chr(9) || q2 || chr(9) || umi as value from reads")
def reads_to_tirp(spark, sf_dir):
    return convert.to_tirp(view(spark, sf_dir, "reads"), "lib")


@query(f"{ALIGNMENTS} select ordinal, qname || chr(9) || flag || chr(9) || chrom || chr(9) || 'CB:Z:' || cell_id || chr(9) || 'UB:Z:' || umi as line from alignments")
def sam_add_tags(spark, sf_dir):
    lines = view(spark, sf_dir, "alignments").withColumn("line", F.concat_ws("\t", "qname", F.col("flag").cast("string"), "chrom", F.lit("CB:Z:old")))
    return lines.select("ordinal", S.sam_tags("line").alias("line"))


@query(f"{ALIGNMENTS} select ordinal, cell_id as cell, umi, qname as prefix from alignments")
def parse_qname(spark, sf_dir):
    return view(spark, sf_dir, "alignments").select("ordinal", S.qname_cell("qname").alias("cell"), S.qname_umi("qname").alias("umi"), S.qname_prefix("qname").alias("prefix"))


@query(f"{ALIGNMENTS} select ordinal, cast({MATCHED} as bigint) as matched, cast(m_len + case when spliced then 30 else 0 end as bigint) as span from alignments")
def cigar_sums(spark, sf_dir):
    return view(spark, sf_dir, "alignments").select("ordinal", S.matched_bases("cigar").alias("matched"), S.reference_span("cigar").alias("span"))


@query(f"{READS} select ordinal, reverse(translate(r1, 'ACGT', 'TGCA')) as rc, regexp_replace(r2, '^T+', '') as trimmed from reads")
def revcomp_reads(spark, sf_dir):
    return view(spark, sf_dir, "reads").select("ordinal", S.revcomp("r1").alias("rc"), S.trim_poly_t("r2").alias("trimmed"))


@query(f"""{READS}, n as (select ordinal // 1000000 as file, ordinal, cell_id, case when lag(cell_id) over (partition by ordinal // 1000000 order by ordinal) = cell_id then 0 else 1 end as new from reads), r as (select *, sum(new) over (partition by file order by ordinal) as run from n)
    select file, cell_id, min(ordinal) as first_ordinal, max(ordinal) as last_ordinal, count(*) as n_rows from r group by file, cell_id, run""")
def group_relaxed_islands(spark, sf_dir):
    return filters.islands(view(spark, sf_dir, "reads").select(F.expr("ordinal div 1000000").alias("file"), "ordinal", "cell_id"), ["file"], "ordinal", "cell_id")


@query(f"{READS} select file_id, cell_id, count(*) as n_reads from (select '0' as file_id, cell_id from reads union all select '1', cell_id from reads where length(r2) > 0) group by all")
def union_inputs(spark, sf_dir):
    reads = view(spark, sf_dir, "reads")
    return layout.union_inputs([reads, reads.where("length(r2) > 0")]).groupBy("file_id", "cell_id").agg(F.count("*").alias("n_reads"))


@query(f"{ALIGNMENTS} select dense_rank() over (order by cell_id) - 1 as row, dense_rank() over (order by chrom) - 1 as col, count(*) as cnt from alignments group by cell_id, chrom")
def dense_triplets(spark, sf_dir):
    return counts.dense_triplets(view(spark, sf_dir, "alignments").select("cell_id", F.col("chrom").alias("feature"), F.lit(1).cast("long").alias("cnt")))


@query(f"{ALIGNMENTS} select cell_id, cast(mapq % 4 as int) as taxid, count(*) as n_pairs from (select cell_id, coalesce(mapq, 0) as mapq from alignments) group by all")
def taxon_counts(spark, sf_dir):
    return counts.taxon_counts(view(spark, sf_dir, "alignments").selectExpr("cell_id", "nullif(coalesce(mapq, 0) % 4, 0) as taxid"))


_QUALITY = f"{READS}, m as (select cell_id, r1 as s, q1 as q from reads union all select cell_id, r2, q2 from reads), l as (select *, length(s) as len, length(s) - length(translate(s, 'GC', '')) as gc, length(s) - length(translate(s, 'N', '')) as ns, list_sum(list_transform(string_split(q, ''), lambda c: ord(c) - 33)) as quality from m where length(s) > 0)"


@query(f"{_QUALITY} select cell_id, count(*) as n_mates, round(avg(len), 6) as mean_length, round(sum(gc) * 100 / sum(len), 6) as gc_percent, round(sum(ns) * 100 / sum(len), 6) as n_percent, round(sum(quality) / sum(len), 6) as mean_quality from l group by cell_id")
def read_quality(spark, sf_dir):
    return counts.read_quality(view(spark, sf_dir, "reads"))


@query(f"{READS}, {WINDOWS}, h as (select cell_id, cast('0x' || substr(md5(least(kmer, {RC})), 1, 15) as bigint) as h from w), p as (select cell_id, h & 15 as pos, sum(case when (h >> 32) & 1 = 0 then 1 else -1 end) as val from h group by all), g as (select cell_id, unnest(range(0, 16)) as pos from (select distinct cell_id from reads)), d as (select cell_id, cast(sum(greatest(length(r1) - {K - 1}, 0) + greatest(length(r2) - {K - 1}, 0)) as bigint) as depth from reads group by cell_id) select cell_id, any_value(depth) as depth, string_agg(cast(coalesce(val, 0) as bigint), ',' order by pos) as sketch from g left join p using (cell_id, pos) join d using (cell_id) group by cell_id")
def sketch_matrix(spark, sf_dir):
    reads = view(spark, sf_dir, "reads")
    sketch = kmers.count_sketch(reads, K, 16, "md5")
    return kmers.sketch_matrix(sketch, kmers.sketch_depth(reads, K), 16).withColumn("sketch", F.array_join("sketch", ","))


@query(f"{READS} select cell_id, ordinal from reads where length(r1) + length(r2) > 60")
def filter_length(spark, sf_dir):
    return filters.long_enough(view(spark, sf_dir, "reads")).select("cell_id", "ordinal")


@query(f"{READS} select cell_id, ordinal from reads order by ordinal limit 100")
def first_pairs(spark, sf_dir):
    return filters.first_pairs(view(spark, sf_dir, "reads").select("cell_id", "ordinal"), 100)


@query(f"{ALIGNMENTS} select ordinal, qname from (select *, lag(chrom) over (partition by qname order by ordinal) as before from alignments) where before is null or before <> chrom")
def filter_with_previous(spark, sf_dir):
    return filters.filter_with_previous(view(spark, sf_dir, "alignments"), "prev_chrom is null or prev_chrom <> chrom", ["qname"], "ordinal", ["chrom"]).select("ordinal", "qname")


@query("with c as (select 'cell' || n_regionkey as cell_id, cast(count(*) as varchar) as n from nation group by n_regionkey) select cell_id, 'count.txt' as file_name, n as text from c union all select cell_id, '_mapcell.log', 'ok' from c")
def mapcell_apply(spark, sf_dir):
    files = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("'cell' || n_regionkey as cell_id", "n_name as file_name", "encode(n_name, 'utf-8') as content")
    count = mapcell.CellFunction(lambda held: ({"count.txt": str(len(held)).encode()}, "ok"))
    return mapcell.map_cells(files, count).select("cell_id", "file_name", F.decode("content", "utf-8").alias("text"))


_FLIP = "reverse(translate({}, 'ACGT', 'TGCA'))"
_AGREE = "list_sum(list_transform(range(1, {} + 1), lambda j: case when substr(r1, i + j, 1) = substr(probe, j, 1) and substr(probe, j, 1) <> 'N' then 1 else 0 end))"


@query(f"""{READS}, s as (select *, case when ordinal % 3 = 0 then 0 else ordinal * 37 % 120 end as back from reads),
    p as (select ordinal, cell_id, umi, r1, q1, substr(r1, greatest(length(r1) - back, 0) + 1) || r2 as flipped, reverse(substr(q1, greatest(length(q1) - back, 0) + 1) || q2) as q2 from s),
    m as (select *, {_FLIP.format("flipped")} as r2, length(r1) as n1, length(flipped) as n2 from p),
    o as (select ordinal, r1, n1, n2, which, before, substr(flipped, before + 1, 16) as probe from (select *, unnest([1, 2]) as which, unnest([n2 - 44, 0]) as before from m) where before >= 0 and n1 >= 16 and n2 >= 16),
    t as (select *, {_AGREE.format(8)} as tip, {_AGREE.format(16)} as total, n1 - i as rest from (select *, unnest(range(0, n1)) as i from o)),
    l as (select *, max(i) filter (tip > 5 and rest >= 32) over (partition by ordinal, which) as last from t),
    c as (select *, case when tip > 5 and rest >= 32 and total > 14 then 0 when i = last and total > 13 then 1 when tip > 5 and rest between 9 and 16 and least(rest, 16) - total < 2 then 2 when rest < 8 and rest - total < 2 then 3 end as rank from l),
    f as (select ordinal, which, before, rest from c where rank is not null qualify row_number() over (partition by ordinal, which order by rank, i) = 1),
    x as (select ordinal, rest + before as overlap from f qualify row_number() over (partition by ordinal order by rest desc, which desc) = 1),
    w as (select m.*, coalesce(overlap, 0) as overlap, n1 + n2 - coalesce(overlap, 0) as fragment from m left join x using (ordinal)),
    e as (select *, case when overlap > 0 then least(n1, fragment) else n1 end as end1, case when overlap > 0 then greatest(0, least(n2, fragment - 44)) else n2 end as end2 from w where not (overlap > 0 and fragment < n1 and fragment < 44))
    select cell_id, substr(r1, 45, greatest(end1 - 44, 0)) as r1, substr(r2, from2 + 1, end2 - from2) as r2, substr(q1, 45, greatest(end1 - 44, 0)) as q1, substr(q2, from2 + 1, end2 - from2) as q2, umi, cast(overlap as int) as overlap
    from (select *, case when overlap > 0 then least(1, end2) else 0 end as from2 from e)""")
def trim_overlap(spark, sf_dir):
    # Each pair as a fragment r1 + r2 read from both ends: the second mate reaches 0 to 119 bases back into r1, every third none.
    reads = view(spark, sf_dir, "reads").withColumns({c: F.coalesce(c, F.lit("")) for c in ("r1", "r2", "q1", "q2")})
    back = F.when(F.coalesce("ordinal", F.lit(0)) % 3 == 0, 0).otherwise(F.coalesce("ordinal", F.lit(0)) * 37 % 120).cast("int")
    far = lambda a, b: F.concat(F.substr(F.col(a), F.greatest(F.length(a) - back, F.lit(0)) + 1), F.col(b))
    return barcodes.trim_overlaps(reads.withColumns({"r2": S.revcomp(far("r1", "r2")), "q2": F.reverse(far("q1", "q2"))}))


_LINKERS = " + ".join(f"(substr(seq, i + {8 + 12 * j + b}, 1) = '{base}')::int" for j, linker in enumerate(barcodes.LINKERS) for b, base in enumerate(linker))


@query(f"""{READS}, s as (select ordinal, r1 || r2 as seq from reads), p as (select ordinal, length(seq) as n, i, {_LINKERS} as score from (select *, unnest(range(1, greatest(least(length(seq), 300) - 43, 1) + 1)) as i from s)),
    b as (select *, n >= 44 and score >= 10 as ok from p qualify row_number() over (partition by ordinal order by score desc, i) = 1)
    select ordinal, cast(case when ok then i - 1 end as int) as place, cast(case when ok then score end as int) as linker_score from b""")
def linker_scan(spark, sf_dir):
    return barcodes.find_linkers(view(spark, sf_dir, "reads").select("ordinal", F.concat("r1", "r2").alias("seq"))).select("ordinal", "place", "linker_score")


@query(f"{READS} select cell_id, count(*) as n_reads from reads group by cell_id")
def stream_counts(spark, sf_dir):
    from cytoloom.streaming.counts import stream_histogram

    return stream_histogram(spark, sf_dir)


_BINNED = ORACLE_SQL["binned_coverage"]
ZOOM = [200, 800, 3200]


@query(" union all ".join(f"""select cast({level} as int) as level, chrom, cast(bin * {w} as bigint) as start, cast((bin + 1) * {w} as bigint) as "end", cast(sum(p) as bigint) as covered, min(bases) as least, max(bases) as most, cast(sum(bases * p) as bigint) as total, cast(sum(bases * bases * p) as bigint) as squares
    from (select *, least("end", (bin + 1) * {w}) - greatest(start, bin * {w}) as p from (select *, unnest(range(start // {w}, ("end" - 1) // {w} + 1)) as bin from ({_BINNED}) b)) group by chrom, bin""" for level, w in enumerate(ZOOM)))
def zoom_levels(spark, sf_dir):
    return intervals.zoom_levels(binned_coverage(spark, sf_dir), ZOOM)


CSR_ROWS = 20


@query(f"""{ALIGNMENTS}, t as (select dense_rank() over (order by cell_id) - 1 as row, dense_rank() over (order by chrom) - 1 as col, count(*) as cnt from alignments group by cell_id, chrom), r as (select row, count(*) as n from t group by row), p as (select row, n, sum(n) over (order by row) as stop from r),
    i as (select row // {CSR_ROWS} as block, count(*) as n_rows, cast(min(stop - n) as varchar) || ',' || string_agg(cast(stop as varchar), ',' order by row) as indptr from p group by all)
    select cast(block as bigint) as block, cast(block * {CSR_ROWS} as bigint) as first_row, cast(n_rows as int) as n_rows, indptr, string_agg(cast(col as varchar), ',' order by row, col) as indices, string_agg(cast(cnt as varchar), ',' order by row, col) as data from t join i on row // {CSR_ROWS} = block group by all""")
def csr_blocks(spark, sf_dir):
    triplets = counts.dense_triplets(view(spark, sf_dir, "alignments").select("cell_id", F.col("chrom").alias("feature"), F.lit(1).cast("long").alias("cnt")))
    return counts.csr_blocks(materialise(triplets, "triplets"), CSR_ROWS).withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("indptr", "indices", "data")})


_POSITIONS = f"{READS}, m as (select cell_id, 1 as mate, r1 as s, q1 as q from reads union all select cell_id, 2, r2, q2 from reads), p as (select cell_id, mate, pos, substr(s, pos + 1, 1) as base, ord(substr(q, pos + 1, 1)) - 33 as q from (select *, unnest(range(0, length(s))) as pos from m))"
_BASES = ", ".join(f"count(*) filter (base = '{b.upper()}') as {b}" for b in "acgt")


@query(f"{_POSITIONS} select cell_id, cast(mate as int) as mate, cast(pos as int) as pos, count(*) as n, cast(sum(q) as bigint) as quality, {_BASES}, count(*) filter (base not in ('A', 'C', 'G', 'T')) as other from p group by all")
def position_report(spark, sf_dir):
    return counts.position_report(view(spark, sf_dir, "reads"))


@query(f"{READS}, d as (select cell_id, r1, r2, count(*) as copies from reads group by all) select cell_id, copies, count(*) as n_sequences from d group by all")
def duplication_levels(spark, sf_dir):
    return counts.duplication_levels(view(spark, sf_dir, "reads"))


@query(f"{READS} select cell_id, count(*) as n_reads, row_number() over (order by cell_id) - 1 as place from reads group by cell_id")
def ordered_report(spark, sf_dir):
    return layout.with_place(counts.cell_histogram(view(spark, sf_dir, "reads")), ["cell_id"])
