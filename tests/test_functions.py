"""Expressions and small operators on golden values."""

import pytest
from pyspark.sql import functions as F

from cytoloom.functions import sequence as S
from cytoloom.operators import assembly, barcodes, convert, counts, filters, intervals, kmers, layout, mapcell, umis


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


def test_revcomp(spark):
    assert one(spark, S.revcomp("s"), s="ATGCTTCCAGAA") == "TTCTGGAAGCAT"
    assert one(spark, S.revcomp("s"), s="ATGCTTCCAGNAA") == "TTNCTGGAAGCAT"
    assert one(spark, S.revcomp(S.revcomp("s")), s="ACGTNNA") == "ACGTNNA"
    assert one(spark, S.complement("s"), s="acgTN") == "tgcAN"


def test_kmers(spark):
    assert one(spark, S.kmers("s", 3), s="ACGTA") == ["ACG", "CGT", "GTA"]
    assert one(spark, S.kmers("s", 6), s="ACGTA") == []
    assert one(spark, S.canonical("s"), s="TTG") == "CAA"


def test_names_and_tags(spark):
    assert one(spark, S.qname_cell("q"), q="c:u:7") == "c" and one(spark, S.qname_umi("q"), q="c:u:7") == "u"
    assert one(spark, S.qname_prefix("q"), q="c::7") == "c" and one(spark, S.qname_prefix("q"), q="c:u:7") == "c:u:7"
    assert one(spark, S.read_name("c", "u", "n"), c="A1", u="", n=3) == "A1::3"
    assert one(spark, S.sam_tags("l"), l="c:u:1\t4\tCB:Z:old\tUB:Z:old\tNM:i:0") == "c:u:1\t4\tNM:i:0\tCB:Z:c\tUB:Z:u"
    assert one(spark, S.sam_tags("l"), l="c::1\t4") == "c::1\t4\tCB:Z:c"
    assert one(spark, S.sam_tags("l"), l="@HD\tVN:1.6") == "@HD\tVN:1.6"
    assert one(spark, S.cell_name([F.lit("A1"), F.lit("B2")], "lib")) == "lib_A1_B2"
    assert one(spark, S.trim_poly_t("s"), s="TTTACT") == "ACT"
    assert one(spark, S.genome_url("p"), p="ftp://h/a/GCF_1/") == "https://h/a/GCF_1/GCF_1_genomic.fna.gz"
    assert one(spark, S.hamming("a", "b"), a="ACGN", b="ACTN") == 2
    assert one(spark, S.umi_code("u"), u="ATGC") == 0b00011011


def alignments(spark, rows):
    schema = "file_id string, ordinal long, qname string, flag int, chrom string, pos long, end_pos long, mapq int, cigar array<struct<op: string, len: int>>, l_seq int"
    return spark.createDataFrame(rows, schema).withColumn("cell_id", S.qname_cell("qname")).withColumn("umi", S.qname_umi("qname"))


def cigar(text):
    import re

    return [(op, int(n)) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", text)]


@pytest.mark.parametrize("flag, text, absolute, percent, keeps", [(0, "10M", 0, 90, True), (0, "9M1S", 0, 90, True), (0, "7M3S", 0, 90, False), (4, "10M", 0, 90, False), (0, "6M4S", 6, 80, True), (0, "1M9S", 0, 0, True)])
def test_mapped_filter(spark, flag, text, absolute, percent, keeps):
    rows = alignments(spark, [("f", 1, "c:u:1", flag, "r", 5, 15, 9, cigar(text), 10)])
    assert filters.split_mapped(rows, absolute, percent).count() == int(keeps)
    assert filters.split_mapped(rows, absolute, percent, keep_unmapped=True).count() == int(not keeps)


def test_mates_stay_together(spark):
    rows = alignments(spark, [("f", 1, "c:u:1", 65, "r", 5, 15, 9, cigar("10M"), 10), ("f", 2, "c:u:1", 129 + 4, None, -1, -1, 0, [], 10), ("f", 3, "c:u:2", 129 + 4, None, -1, -1, 0, [], 10)])
    assert [r["ordinal"] for r in filters.split_mapped(rows).orderBy("ordinal").collect()] == [1, 2]


def test_multimappers(spark):
    rows = alignments(spark, [("f", i, "c:u:1", f, "r", 1, 2, q, cigar("1M"), 1) for i, (f, q) in enumerate([(0, None), (0, 0), (0, 1), (0x100, 9), (0x800, 9)])])
    assert [r["ordinal"] for r in filters.unique_mappers(rows).collect()] == [2]


def test_repeated_starts(spark):
    rows = alignments(spark, [("f", i, "c:u:1", 0, "r", p, p + 1, 9, cigar("1M"), 1) for i, p in enumerate([3, 3, 3, 4, 3])])
    assert counts.count_chrom(rows, remove_duplicates=True).first()["n_reads"] == 3


def test_blocks_and_coverage(spark):
    rows = alignments(spark, [("f", 1, "c:u:1", 0, "r", 10, 40, 9, cigar("10M5D10=2I5N5S"), 27), ("f", 2, "c:u:2", 0, "r", 10, 20, 9, cigar("10M"), 10)])
    assert [tuple(b) for b in rows.orderBy("ordinal").select(S.aligned_blocks("pos", "cigar").alias("b")).first()["b"]] == [(10, 20), (25, 35)]
    assert one(spark, F.lit(1)) == 1
    assert [r["rle"] for r in intervals.coverage_rle(rows).collect()] == ["10:2:10,20:1:20"]
    cover = intervals.aligned_coverage(rows).first()
    assert (cover["union_aligned_bases"], cover["sumof_aligned_bases"], cover["countof_alignments"]) == (30, 40, 2)
    assert sorted((r["start"], r["end"], r["bases"]) for r in intervals.binned_coverage(rows, 10).collect()) == [(10, 20, 20), (20, 40, 5)]


def test_overlap_join_against_all_pairs(spark):
    import random

    rng = random.Random(1)
    a = [(i, rng.choice("xy"), s := rng.randrange(200), s + rng.randrange(0, 60)) for i in range(80)]
    b = [(i, rng.choice("xy"), s := rng.randrange(200), s + rng.randrange(0, 60)) for i in range(80)]
    got = intervals.overlaps(spark.createDataFrame(a, "i long, chrom string, start long, end long"), spark.createDataFrame(b, "j long, chrom string, start long, end long"), 2)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted((i, j) for i, c, s, e in a for j, d, t, f in b if c == d and s < f and t < e and e > s and f > t)


@pytest.mark.parametrize("distance, want", [(1, 2), (0, 4)])
def test_umis(spark, distance, want):
    rows = [("g", u, n) for u, n in (("ATCGATCG", 5), ("ATCGATCC", 2), ("ATTGATCC", 1), ("AAAGATCC", 1))]
    assert umis.directional_umis(spark.createDataFrame(rows, "g string, umi string, cnt long"), ["g"], distance).first()["n_umis"] == want


def test_assembly(spark):
    contigs = spark.createDataFrame([("c", n, 0, 1, 0) for n in (3980, 1610, 1120)] + [("d", 10, 5, 10, 4)], "cell_id string, len long, gc long, acgt long, ns long")
    stats = {r["cell_id"]: r for r in assembly.assembly_stats(contigs).collect()}
    c = stats["c"]
    assert (c["n50"], c["l50"], c["n90"], c["l90"], c["contigs_1000"], c["largest"]) == (3980, 1, 1120, 3, 3, 3980)
    assert c["aun"] == pytest.approx(2934.0, abs=0.1)
    assert stats["d"]["contigs"] == 0 and stats["d"]["n50"] is None and stats["d"]["contigs_0"] == 1
    of = assembly.contigs_of(spark.createDataFrame([("c", "gcATNNNN")], "cell_id string, seq string")).first()
    assert (of["len"], of["gc"], of["acgt"], of["ns"]) == (8, 2, 4, 4)


def test_coordinate_order(spark):
    keys = [(None, -1, 0), ("b", 0, 0), ("a", 99, 0), ("a", 49, 16), ("a", 49, 0)]
    rows = alignments(spark, [("f", i, "c:u:1", f, c, p, p, 9, [], 1) for i, (c, p, f) in enumerate(keys)])
    assert [r["ordinal"] for r in layout.coordinate_order(rows).collect()] == [4, 3, 2, 1, 0]
    assert {r["ordinal"]: r["rank"] for r in layout.coordinate_rank(rows).collect()} == {4: 1, 3: 2, 2: 3, 1: 4, 0: 5}
    header = spark.createDataFrame([("b", 0), ("a", 1)], "name string, ref_id int")
    assert [r["ordinal"] for r in layout.coordinate_order(rows, header).collect()] == [1, 4, 3, 2, 0]


def test_sketch_is_linear(spark):
    reads = spark.createDataFrame([("c", "ACGTACGTTGCA" * 3, "GATTACA" * 4), ("c", "TTGACCA" * 5, "ACG"), ("d", "ACGTT" * 6, "")], "cell_id string, r1 string, r2 string")
    whole = {(r["cell_id"], r["pos"]): r["val"] for r in kmers.count_sketch(reads, 5, 64).collect()}
    parts = kmers.count_sketch(reads.limit(1), 5, 64).unionByName(kmers.count_sketch(reads.exceptAll(reads.limit(1)), 5, 64)).groupBy("cell_id", "pos").agg(F.sum("val").alias("val")).where("val <> 0")
    assert whole == {(r["cell_id"], r["pos"]): r["val"] for r in parts.collect()}


def test_minhash_keeps_copies(spark):
    reads = spark.createDataFrame([("c", "AAAAAA", "")], "cell_id string, r1 string, r2 string")
    assert [(r["kmer"], r["copies"]) for r in kmers.minhash(reads, 3, 2).collect()] == [("AAA", 2)]


@pytest.mark.parametrize("k", [3, 27, 28, 31, 33])
def test_windows_of_any_letters(spark, k):
    import random
    from collections import Counter

    import xxhash

    rng = random.Random(k)
    rows = [(rng.choice(["a", "b", None]), *("".join(rng.choice("ACGT" * 30 + "Nacr") for _ in range(rng.randint(0, 90))) for _ in range(2))) for _ in range(40)]
    rows += [rows[0], ("c", None, None), ("c", "", "ACG"), ("d", "GATTACA" * 20, "T" * 60)]
    reads = spark.createDataFrame(rows, "cell_id string, r1 string, r2 string")
    flip = lambda w: w.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    each = [(c, r[i : i + k]) for c, *mates in rows for r in mates for i in range(len(r or "") - k + 1)]
    count = Counter((c, min(w, flip(w))) for c, w in each if "N" not in w)
    assert {(r["cell_id"], r["kmer"]): r["cnt"] for r in kmers.kmer_counts(reads, k).collect()} == count
    least = {c: Counter(w for _, w in sorted((xxhash.xxh64_intdigest(w.encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(w.encode(), 42) >> 63), w) for d, w in each if d == c)[:9]) for c in {c for c, _ in each}}
    got = kmers.minhash(reads, k, 9).collect()
    assert {(r["cell_id"], r["kmer"]): r["copies"] for r in got} == {(c, w): n for c, some in least.items() for w, n in some.items()}
    listed = sorted({w for _, w in each})[::5]
    want = Counter((c, f) for c, w in each for f in (w, flip(w)) if f in set(listed))
    assert {(r["cell_id"], r["feature"]): r["cnt"] for r in kmers.feature_counts(reads, spark.createDataFrame([(w,) for w in listed], "kmer string"), k).collect()} == want


def test_feature_counts_count_palindromes_twice(spark):
    reads = spark.createDataFrame([("c", "ACGT", "")], "cell_id string, r1 string, r2 string")
    got = kmers.feature_counts(reads, spark.createDataFrame([("ACGT",), ("TTTT",)], "kmer string"), 4)
    assert [(r["feature"], r["cnt"]) for r in got.collect()] == [("ACGT", 2)]


def test_probe():
    probe = "ACGTTGCAACGGTTAC"
    reads = ["T" * 30 + probe + "G" * 40, "C" * 60 + probe[:12], "C" * 60 + probe[:5], "N" * 80, "", probe]
    # Of the last base alone none has to agree, so a probe of which nothing is found stands there.
    assert barcodes.probe_places(reads, [probe] * len(reads)).tolist() == [30, 60, 60, 79, -1, 0]


def test_pairs_that_share_nothing_keep_their_bases(spark):
    rows = spark.createDataFrame([("c", "A" * 100, "AC" * 40, "F" * 100, "F" * 80, "u"), ("c", None, "ACG", None, "FFF", None)], "cell_id string, r1 string, r2 string, q1 string, q2 string, umi string")
    got = sorted(barcodes.trim_overlaps(rows).collect(), key=lambda r: len(r["r2"]))
    assert [(r["overlap"], r["r1"], r["r2"]) for r in got] == [(0, "", "ACG"), (1, "A" * 56, ("AC" * 40)[1:])]


def test_trim_overlap_runs_once_and_queues_no_source_text(spark):
    rows = spark.createDataFrame([("c", "ACGT" * 30)], "cell_id string, text string").selectExpr("cell_id", "explode(sequence(1, 3)) as i", "text")
    part = F.expr("substr(text, i, 60)")
    pairs = rows.select("cell_id", part.alias("r1"), S.revcomp(part).alias("r2"), part.alias("q1"), part.alias("q2"), F.lit("u").alias("umi"))
    plan = barcodes.trim_overlaps(pairs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_trim_overlap(spark):
    import random

    rng = random.Random(2)
    insert = "".join(rng.choice("ACGT") for _ in range(90))
    code = "".join(rng.choice("ACGT") for _ in range(44))
    r1 = code + insert
    r2 = r1[::-1].translate(str.maketrans("ACGT", "TGCA"))[:100]
    rows = spark.createDataFrame([("c", r1, r2, "F" * len(r1), "F" * len(r2), "")], "cell_id string, r1 string, r2 string, q1 string, q2 string, umi string")
    got = barcodes.trim_overlaps(rows).first()
    assert got["overlap"] == 100 and got["r1"] == insert and got["r2"] == r2[1:90] and len(got["q2"]) == len(got["r2"])


def test_linkers(spark):
    seq = "G" * 7 + "A" * 8 + "AGGA" + "C" * 8 + "ACTC" + "T" * 8 + "AAGG" + "G" * 8 + "ACGT"
    got = barcodes.find_linkers(spark.createDataFrame([(seq,), ("G" * 60,), ("A",)], "seq string")).collect()
    assert [(r["place"], r["linker_score"]) for r in got] == [(7, 12), (None, None), (None, None)]


def test_filters_with_context(spark):
    rows = spark.createDataFrame([("f", i, c) for i, c in enumerate("aabba")], "file_id string, ordinal long, cell_id string")
    assert [r["n_rows"] for r in filters.islands(rows, ["file_id"], "ordinal", "cell_id").orderBy("first_ordinal").collect()] == [2, 2, 1]
    with pytest.raises(Exception, match="not sorted"):
        filters.assert_sorted(rows).collect()
    assert filters.assert_sorted(rows.where("ordinal < 4")).count() == 4
    files = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "cell_id string, file_name string")
    assert [r[0] for r in filters.cells_with_files(files, ["x", "y"]).collect()] == ["a"]
    assert filters.include_cells(rows, spark.createDataFrame([("b",), ("",)], "cell_id string")).count() == 2


def test_conversions(spark):
    reads = spark.createDataFrame([("c", 1, "AC", "GT", "FF", "##", "u"), ("c", 0, "A", "C", "F", "F", "v")], "cell_id string, ordinal long, r1 string, r2 string, q1 string, q2 string, umi string")
    assert {r["r1_fastq"] for r in convert.to_fastq(reads).collect()} == {"@c:v:0 1\nA\n+\nF", "@c:u:1 1\nAC\n+\nFF"}
    assert "lib_c\t1\t1\tAC\tGT\tFF\t##\tu" in {r["value"] for r in convert.to_tirp(reads, "lib").collect()}
    with pytest.raises(Exception, match="differ in length"):
        convert.to_tirp(reads.withColumn("q1", F.lit("F"))).collect()
    fasta = spark.createDataFrame([("c", ">a x\nACGT\nAC\n>b\nTT\n")], "cell_id string, content string")
    assert sorted((r["r1"], r["q1"]) for r in convert.fasta_to_reads(fasta).collect()) == [("ACGTAC", "FFFFFF"), ("TT", "FF")]


def test_mapcell(spark, tmp_path):
    files = spark.createDataFrame([("a", "x", b"1"), ("a", "y", b"2"), ("b", "y", b"3")], "cell_id string, file_name string, content binary")
    swap = mapcell.CellFunction(lambda held: ({k: v[::-1] for k, v in held.items()}, "done"), ("x",))
    got = {(r[0], r[1]): bytes(r[2]) for r in mapcell.map_cells(files, swap).collect()}
    assert got[("a", "_mapcell.log")] == b"done" and got[("b", "_mapcell.log")].startswith(b"skipped") and ("b", "y") not in got
    script = tmp_path / "count.sh"
    script.write_text('#!/bin/bash\ncase $1 in\n--*-api) echo "my mapcell-api 1.0";;\n--preflight-check) echo MAPCELL-CHECK;;\n--expect-files) echo x,y;;\n--missing-file-mode) echo skip;;\n--input-dir) ls $2 | wc -l > $4/n.txt; echo MAPCELL-OK;;\nesac\n')
    script.chmod(0o755)
    got = {(r[0], r[1]): bytes(r[2]) for r in mapcell.map_cells(files, mapcell.script_function(str(script))).collect()}
    assert got[("a", "n.txt")].strip() == b"2" and got[("b", "_mapcell.log")].startswith(b"skipped")
    preset = mapcell.PRESETS["minhash_fq"](k=3, n=2)
    reads = spark.createDataFrame([("a", "r1.fq", b"@x\nACGTA\n+\nFFFFF\n")], "cell_id string, file_name string, content binary")
    assert len(bytes(mapcell.map_cells(reads, preset).where("file_name = 'minhash.txt'").first()["content"]).split()) == 2


def test_numbered_and_merge(spark):
    rows = spark.range(100).select(F.col("id"), (F.col("id") % 3).cast("string").alias("cell_id")).repartition(5)
    got = layout.numbered(rows, ["id"], ["cell_id"]).collect()
    assert all(r["num"] == r["id"] // 3 for r in got)
    merged = layout.merge_sorted([rows, rows], 3).withColumn("p", F.spark_partition_id())
    assert merged.groupBy("cell_id").agg(F.countDistinct("p").alias("n")).where("n > 1").count() == 0 and merged.count() == 200


def test_counters_and_cell_files(spark):
    reads = spark.createDataFrame([("c", 1, "AC", "GT", "FF", "##", "u"), ("c", 0, "A", "C", "F", "F", "v")], "cell_id string, ordinal long, r1 string, r2 string, q1 string, q2 string, umi string")
    rows, watch = filters.observed(reads, short=F.length("r1") < 2)
    assert rows.count() == 2 and watch.get == {"rows": 2, "short": 1}
    files = {r["file_name"]: bytes(r["content"]) for r in convert.reads_to_files(reads).collect()}
    assert files["r1.fq"] == b"@c:v:0 1\nA\n+\nF\n@c:u:1 1\nAC\n+\nFF\n" and set(files) == {"r1.fq", "r2.fq"}
    same = mapcell.map_batches(reads.select("cell_id"), lambda batches: batches, "cell_id string")
    assert same.count() == 2
    assert [r["place"] for r in filters.cells_in_order(reads, ["x", "c", "c"]).collect()] == [1, 1]


@pytest.mark.parametrize("k", [1, 3, 8, 11, 16, 27, 31, 55])
def test_hashes_of_many_texts(k):
    import hashlib

    import numpy as np
    import xxhash

    from cytoloom.operators import hashes

    text = np.random.default_rng(k).integers(65, 91, (hashes.ROWS + 3, k)).astype(np.uint8)
    high, low = hashes.md5(text)
    for i in (0, 1, hashes.ROWS, hashes.ROWS + 2):
        assert f"{high[i]:016x}{low[i]:016x}" == hashlib.md5(text[i].tobytes()).hexdigest()
        assert k > hashes.LONGEST_XXHASH or hashes.xxhash64(text)[i] == xxhash.xxh64_intdigest(text[i].tobytes(), 42)


@pytest.mark.parametrize("by", ["md5", "xxhash64"])
def test_sketches_over_many_batches(spark, monkeypatch, by):
    """Windows are dropped before they are spelled, over many merges, and what a task holds is handed on in between."""
    import random

    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), "".join(rng.choice("ACGTNx") for _ in range(30)), "ACGTA" * 3) for _ in range(300)]
    held = []
    for letters, rest in ((100, 7), (1 << 20, 1 << 20)):
        for name, value in (("LETTERS", letters), ("ASIDE", rest), ("HELD", rest)):
            monkeypatch.setattr(kmers, name, value)
        batches = [__import__("pyarrow").RecordBatch.from_pylist([dict(zip(("cell_id", "r1", "r2"), r)) for r in rows[i : i + 40]]) for i in range(0, 300, 40)]

        class Rows:
            select = lambda self, *c: self
            mapInArrow = lambda self, f, schema: list(f(iter(batches)))  # noqa: B023, E731

        import pyarrow as pa

        held.append(kmers._least(pa.Table.from_batches(kmers.sketch_parts(Rows(), 4, 9, by)), 9).to_pylist())
    assert held[0] == held[1] and {r["cell_id"] for r in held[0]} == {"a", "b", None}


def test_sketch_kernel_hashes_a_million_windows_in_seconds():
    import time

    import numpy as np
    import pyarrow as pa

    letters = np.random.default_rng(1).choice(np.frombuffer(b"ACGT", np.uint8), (8000, 150))
    batch = pa.record_batch({"cell_id": ["c"] * 8000, "r1": [x.tobytes().decode() for x in letters], "r2": [""] * 8000})

    class Rows:
        select = lambda self, *c: self
        mapInArrow = lambda self, f, schema: f(iter([batch]))

    start = time.thread_time()
    assert sum(len(x) for x in kmers.sketch_parts(Rows(), 14, 50, "md5")) == 50
    assert time.thread_time() - start < 3.5
