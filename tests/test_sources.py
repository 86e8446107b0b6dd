"""Files written here and read back."""

import gzip
import struct

import pytest
from pyspark.sql import functions as F

from cytoloom.sources import formats, readers
from cytoloom.sources.blocks import EOF_BLOCK, is_blocked, scan_blocks, write_block

READS = [(f"r{i}", "ACGT" * (1 + i % 5), "@FF+" * (1 + i % 5)) for i in range(500)]


def fastq(rows):
    return "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in rows).encode()


def blocked(data, name=None, size=1000):
    return b"".join(write_block(data[i : i + size], name) for i in range(0, len(data), size)) + EOF_BLOCK


@pytest.mark.parametrize("end, pack", [("fastq", bytes), ("fastq.gz", gzip.compress), ("fastq.gz", blocked)])
def test_fastq_in_ranges(spark, tmp_path, end, pack):
    path = tmp_path / f"a_R1.{end}"
    path.write_bytes(pack(fastq(READS)))
    got = readers.read_fastq(spark, str(path), split_mb=0.002).orderBy("ordinal").collect()
    assert [(r["name"], r["seq"], r["qual"]) for r in got] == READS


def test_fastq_cut_short(spark, tmp_path):
    path = tmp_path / "a.fq"
    path.write_bytes(fastq(READS)[:-9])
    with pytest.raises(Exception, match="cut short|no FASTQ record"):
        readers.read_fastq(spark, str(path)).collect()


def test_paired_and_list_fastq(spark, tmp_path):
    for mate in "12":
        (tmp_path / f"a_R{mate}.fastq.gz").write_bytes(gzip.compress(fastq([(f"c{i % 3}:u{i}:{i} {mate}", "ACGT"[i % 4] * int(mate), "F" * int(mate)) for i in range(50)])))
    rows = readers.read_paired_fastq(spark, str(tmp_path / "a_R1.fastq.gz")).orderBy("ordinal").collect()
    assert [(r["cell_id"], r["umi"], r["r1"], r["r2"]) for r in rows] == [(f"c{i % 3}", f"u{i}", "ACGT"[i % 4], "ACGT"[i % 4] * 2) for i in range(50)]
    (tmp_path / "x.listfastq").write_text(f"cell\t{tmp_path}/a_R1.fastq.gz\t{tmp_path}/a_R2.fastq.gz\n")
    assert {r["cell_id"] for r in readers.read_any(spark, str(tmp_path / "x.listfastq")).collect()} == {"cell"}


def test_tirp(spark, tmp_path):
    lines = [f"c{i // 40}\t1\t1\tACGT\tAC\tFFFF\tFF\tu{i}" for i in range(400)]
    plain, packed = tmp_path / "a.tirp", tmp_path / "b.tirp.gz"
    plain.write_text("\n".join(lines) + "\n")
    packed.write_bytes(blocked(plain.read_bytes(), "c0", 700))
    for path in (plain, packed):
        rows = readers.read_tirp(spark, str(path), split_mb=0.001).orderBy("ordinal").collect()
        assert [r["umi"] for r in rows] == [f"u{i}" for i in range(400)]
    blocks = readers.read_blocks(spark, str(packed)).orderBy("offset").collect()
    assert {r["cell_id"] for r in blocks} == {"c0", None} and sum(r["size"] for r in blocks) == packed.stat().st_size
    readers.write_tirp(readers.read_tirp(spark, str(plain)), str(tmp_path / "out"), "lib", 3)
    back = spark.read.text(str(tmp_path / "out"))
    assert back.count() == 400 and back.first()[0].startswith("lib_c")


def test_broken_block(spark, tmp_path):
    data = bytearray(blocked(b"c\t1\t1\tA\tC\tF\tF\tu\n" * 50))
    data[40] ^= 255
    path = tmp_path / "a.tirp.gz"
    path.write_bytes(bytes(data))
    assert is_blocked(str(path)) and len(list(scan_blocks(str(path)))) == 2
    with pytest.raises(Exception):
        readers.read_tirp(spark, str(path)).collect()


def bam(records, size=100):
    out = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"r1\0" + struct.pack("<i", 1000)
    for name, flag, ref, pos, mapq, cigar, seq, qual in records:
        packed = [("=ACMGRSVTWYHKDBN".index(c)) for c in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(op)) for op, n in cigar) + bytes(a << 4 | b for a, b in zip(packed[::2], packed[1::2])) + bytes(q - 33 for q in qual.encode())
        out += struct.pack("<i", len(body)) + body
    return blocked(out, size=size)


def test_bam(spark, tmp_path):
    from cytoloom.operators.convert import bam_to_reads

    path = tmp_path / "a.bam"
    path.write_bytes(bam([("c:u:1", 65, 0, 10, 30, [("M", 3), ("D", 2), ("M", 1)], "ACGT", "ABCD"), ("c:u:1", 129 + 16, 0, 40, 255, [("M", 3)], "AAC", "ABC"), ("c:u:2", 4, -1, -1, 0, [], "N", "#"), ("c:u:1", 0x100, 0, 1, 1, [], "A", "A")]))
    rows = readers.read_bam(spark, str(path)).orderBy("ordinal").collect()
    assert [(r["qname"], r["chrom"], r["pos"], r["end_pos"], r["mapq"], r["seq"], r["qual"]) for r in rows][:3] == [("c:u:1", "r1", 10, 16, 30, "ACGT", "ABCD"), ("c:u:1", "r1", 40, 43, None, "AAC", "ABC"), ("c:u:2", None, -1, -1, 0, "N", "#")]
    reads = {r["umi"] + str(r["complete"]): r for r in bam_to_reads(readers.read_bam(spark, str(path))).collect()}
    assert reads["uTrue"]["r1"] == "ACGT" and reads["uTrue"]["r2"] == "GTT" and reads["uTrue"]["q2"] == "CBA"


def many_records(n=3000):
    import random

    rng = random.Random(4)
    rows = []
    for i in range(n):
        seq = "".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 150)))
        cigar = [("M", max(1, len(seq))), ("N", rng.randint(0, 40))] if i % 3 else [("S", 2), ("M", 5)]
        rows.append((f"cell{i % 7}:UMI:{i}", rng.choice([0, 16, 99, 4]), 0 if i % 11 else -1, i * 9 if i % 11 else -1, rng.choice([0, 30, 255]), cigar, seq, "F" * len(seq)))
    return rows


KEY = ["qname", "flag", "chrom", "pos", "end_pos", "mapq", "l_seq", "seq", "qual", "ordinal"]


@pytest.mark.parametrize("size", [100, 1777, 40_000])
def test_bam_in_many_ranges(spark, tmp_path, size):
    records = many_records()
    path = tmp_path / "a.bam"
    raw = bam(records, size)
    path.write_bytes(raw)
    whole = readers.read_bam(spark, str(path)).select(KEY).orderBy("ordinal").collect()
    assert [(r["qname"], r["seq"] or "") for r in whole] == [(r[0], r[6]) for r in records]
    parts = readers.read_bam(spark, str(path), split_mb=len(raw) / 12 / (1 << 20))
    assert parts.select(KEY).orderBy("ordinal").collect() == whole
    assert parts.rdd.getNumPartitions() >= 8
    narrow = parts.where("chrom = 'r1' and pos >= 900 and pos < 1800").select(KEY).orderBy("ordinal")
    assert narrow.collect() == [r for r in whole if r["chrom"] and 900 <= r["pos"] < 1800]


def test_region_reads_only_its_blocks(spark, tmp_path):
    from cytoloom.operators import regions

    path = tmp_path / "a.bam"
    path.write_bytes(bam([r for r in many_records(6000) if r[2] == 0], 3000))
    rows = readers.read_bam(spark, str(path)).cache()
    chunks, windows = regions.chunk_index(rows), regions.window_index(rows)
    assert chunks.agg({"n_records": "sum"}).first()[0] == rows.count()
    blocks = len(list(scan_blocks(str(path))))
    for start, end in [(0, 10), (17_000, 17_500), (16_300, 16_500), (50_000, 60_000), (53_000, 53_001)]:
        found = regions.read_region(chunks, windows, "r1", start, end).collect()
        want = rows.where(f"chrom = 'r1' and pos < {end} and greatest(end_pos, pos + 1) > {start}").count()
        assert sum(r["ordinal"] is not None for r in found) == want
        # Windows of 16 kb are 0.3 of this file each.
        assert sum(r["n_blocks"] for r in found) < blocks * (0.15 + 0.3 * ((end - 1 >> 14) - (start >> 14) + 1))
    assert regions.read_region(chunks, windows, "r9", 0, 10).count() == 0


def test_bins_are_those_of_the_published_rule(spark):
    from cytoloom.operators import regions
    from cytoloom.sources.bam import bin_of

    pairs = [(a, a + n) for a in (0, 1, 16_383, 16_384, 131_071, 1_048_570, 8_388_600, 67_108_860, 400_000_000) for n in (0, 1, 2, 17, 20_000, 200_000, 9_000_000)]
    got = spark.createDataFrame(pairs, "start long, end long").withColumn("bin", regions.interval_bin("start", "end")).collect()
    assert all(r["bin"] == bin_of(r["start"], max(r["end"], r["start"] + 1)) for r in got)
    over = spark.createDataFrame([(bin_of(a, max(b, a + 1)), a, b) for a, b in pairs], "bin long, a long, b long")
    for start, end in [(0, 5), (16_000, 17_000), (400_000_100, 400_000_200)]:
        kept = {(r["a"], r["b"]) for r in over.where(regions.bins_over(over["bin"], start, end)).collect()}
        assert {(a, b) for a, b in pairs if a < end and max(b, a + 1) > start} <= kept


def test_bam_written_and_read(spark, tmp_path):
    path = tmp_path / "a.bam"
    path.write_bytes(bam(many_records(), 5000))
    rows = readers.read_bam(spark, str(path))
    readers.write_bam(rows, str(tmp_path / "out"))
    files = sorted(map(str, (tmp_path / "out").glob("*.bam")))
    assert files and not list((tmp_path / "out").glob("_*"))
    same = ["qname", "flag", "chrom", "pos", "end_pos", "mapq", "cigar", "seq", "qual"]
    key = lambda df: sorted(map(repr, df.select(same).collect()))
    assert key(readers.read_bam(spark, *files)) == key(rows)
    places = [(r["chrom"] or "~", r["pos"]) for f in files for r in readers.read_bam(spark, f).orderBy("ordinal").collect()]
    assert places == sorted(places)
    with pytest.raises(Exception, match="differ in length"):
        readers.write_bam(rows.selectExpr("*").withColumn("qual", F.lit("F")), str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").glob("*.bam"))


def read_rows(n=900):
    return [(f"c{i % 3 if i < 600 else 9}", i, "ACGT", "AC", "FFFF", "FF", f"u{i}") for i in range(n)]


TIRP_COLUMNS = "cell_id string, ordinal long, r1 string, r2 string, q1 string, q2 string, umi string"


@pytest.mark.parametrize("split", [64, 0.0004])
def test_blocks_by_cell(spark, tmp_path, split):
    reads = spark.createDataFrame(read_rows(), TIRP_COLUMNS)
    readers.write_blocks(reads, str(tmp_path / "a"), block_rows=25)
    files = sorted(map(str, (tmp_path / "a").glob("*.gz")))
    back = readers.read_tirp(spark, *files, split_mb=split)
    assert sorted(r["umi"] for r in back.collect()) == sorted(r[-1] for r in read_rows())
    assert sorted(r["umi"] for r in back.where("cell_id in ('c1', 'c9')").collect()) == sorted(r[-1] for r in read_rows() if r[0] in ("c1", "c9"))
    blocks = readers.read_blocks(spark, *files, split_mb=split)
    assert blocks.where("cell_id is not null").count() == 3 * 8 + 12
    index = readers.cell_index(blocks)
    found = readers.read_cells(index, spark.createDataFrame([("c9",), ("none",), ("",)], "cell_id string"), split).collect()
    assert sorted(r["umi"] for r in found if r["ordinal"] is not None) == sorted(r[-1] for r in read_rows() if r[0] == "c9")
    opened = sum(r["n_blocks"] for r in found)
    assert opened == 12 if split == 64 else 12 <= opened <= 24


def test_merge_inflates_nothing(spark, tmp_path):
    reads = spark.createDataFrame(read_rows(), TIRP_COLUMNS)
    for library in "ab":
        readers.write_blocks(reads, str(tmp_path / library), library, 40)
    files = sorted(map(str, [*(tmp_path / "a").glob("*.gz"), *(tmp_path / "b").glob("*.gz")]))
    # A block with a broken sum can be copied, but not inflated.
    path = files[0]
    data = bytearray(open(path, "rb").read())
    first = next(scan_blocks(path))
    data[first.size - 8] ^= 255
    open(path, "wb").write(bytes(data))
    readers.merge_blocks(readers.read_blocks(spark, *files), str(tmp_path / "m"), 2)
    merged = sorted(map(str, (tmp_path / "m").glob("*.gz")))
    named = [b for f in merged for b in scan_blocks(f) if b.name]
    assert [b.name for b in named] == sorted(b.name for b in named)
    assert sum(b.size for b in named) == sum(b.size for f in files for b in scan_blocks(f) if b.name)
    with pytest.raises(Exception, match="broken block"):
        readers.read_tirp(spark, *merged).collect()


def test_a_block_is_found_from_any_byte(tmp_path):
    from cytoloom.sources.blocks import find_block, opened

    path = tmp_path / "a.gz"
    path.write_bytes(blocked(bytes(range(256)) * 400 + b"\x1f\x8b\x08\x04" * 300, "cell", 900))
    offsets = [b.offset for b in scan_blocks(str(path))]
    with opened(str(path)) as f:
        for at in range(0, f.size(), 7):
            assert find_block(f, at, f.size()) == min((o for o in offsets if o >= at), default=f.size())


@pytest.mark.parametrize("size", [37, 64, 1000])
def test_lines_on_borders(spark, tmp_path, size):
    lines = [f"c\t1\t1\t{'A' * (i % 40)}\tAC\t{'F' * (i % 40)}\tFF\tu{i}" for i in range(300)]
    data = ("\n".join(lines) + "\n").encode()
    plain, packed = tmp_path / "a.tirp", tmp_path / "b.tirp.gz"
    plain.write_bytes(data)
    # Empty blocks in the middle, and blocks that begin with a line or inside one.
    packed.write_bytes(b"".join(write_block(data[i : i + size]) + (EOF_BLOCK if i % 3 == 0 else b"") for i in range(0, len(data), size)) + EOF_BLOCK)
    for path in (plain, packed):
        for split in (30, 101, 1003):
            if path == packed and split < 100:
                continue
            got = readers.read_tirp(spark, str(path), split_mb=split / (1 << 20)).select("umi").collect()
            assert sorted(r[0] for r in got) == sorted(f"u{i}" for i in range(300))


def test_list_of_pairs(spark, tmp_path):
    rows = []
    for cell in "xyz":
        for mate in "12":
            (tmp_path / f"{cell}_R{mate}.fq.gz").write_bytes(blocked(fastq([(f"{cell}{i}", "ACGT"[i % 4] * int(mate), "F" * int(mate)) for i in range(70)]), size=300))
        rows.append(f"{cell}\t{tmp_path}/{cell}_R1.fq.gz\t{tmp_path}/{cell}_R2.fq.gz\n")
    (tmp_path / "a.listfastq").write_text("".join(rows))
    got = readers.read_list_fastq(spark, str(tmp_path / "a.listfastq"), split_mb=0.0005).collect()
    assert sorted((r["cell_id"], r["ordinal"], r["r1"], r["r2"]) for r in got) == sorted((c, i, "ACGT"[i % 4], "ACGT"[i % 4] * 2) for c in "xyz" for i in range(70))


def test_features(spark, tmp_path):
    (tmp_path / "a.gff").write_text('##gff\nr\ts\tgene\t11\t20\t.\t+\t.\tID=1;gene_id=G1;name=N1\nr\ts\texon\t11\t20\t.\t+\t.\tgene_id=G1\n')
    (tmp_path / "a.gtf").write_text('r\ts\tgene\t1\t5\t.\t-\t.\tgene_id "G2"; other "x";\n')
    (tmp_path / "a.bed").write_text("r\t5\t9\tB1\n")
    rows = [readers.read_features(spark, str(tmp_path / f"a.{k}")).first() for k in ("gff", "gtf", "bed")]
    assert [(r["gene_id"], r["gene_name"], r["start"], r["end"], r["strand"]) for r in rows] == [("G1", "N1", 10, 20, "+"), ("G2", "G2", 0, 5, "-"), ("B1", "r", 5, 9, ".")]
    with pytest.raises(ValueError, match="no feature"):
        readers.read_features(spark, str(tmp_path / "a.gff"), "tRNA")


def test_zip_round_trip(spark, tmp_path):
    files = spark.createDataFrame([(f"c{i % 4}", f"f{i}", bytes([i])) for i in range(20)], "cell_id string, file_name string, content binary")
    for r in readers.zip_bytes(files, 2).collect():
        (tmp_path / f"{r['shard']}.zip").write_bytes(bytes(r["content"]))
    back = readers.read_zip(spark, str(tmp_path / "*.zip"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, files.collect()))
    assert readers.extract(back, "c1", "f5").first()["content"] == b"\x05" and readers.list_cells(back).count() == 4
    with pytest.raises(Exception, match="not a cell id"):
        readers.zip_bytes(files.selectExpr("'../x' as cell_id", "file_name", "content"), 1).collect()


def test_lists(spark, tmp_path):
    (tmp_path / "cells").write_text("a\n\nb\n")
    (tmp_path / "dump").write_text("ACG\t3\n")
    (tmp_path / "wells").write_text("pos\twell\tseq\n1\tA2\tACGTACGT\n1\tA1\tTTTTACGT\n2\tB1\tACGTTTTT\n")
    assert readers.read_cell_list(spark, str(tmp_path / "cells")).count() == 2
    assert tuple(readers.read_kmer_dump(spark, str(tmp_path / "dump"), "c").first()) == ("ACG", 3, "c")
    assert {(r["pool"], r["idx"], r["name"]) for r in readers.read_whitelist(spark, str(tmp_path / "wells")).collect()} == {(1, 0, "A1"), (1, 1, "A2"), (2, 0, "B1")}
    assert [readers.detect_format(f"x{e}") for e in (".tirp.gz", ".zip", ".cram", "_R1.fq.gz", ".fq", ".listfastq", ".tirp.bbgz")] == ["tirp", "zip", "bam", "paired_fastq", "single_fastq", "list_fastq", "other"]


def test_writers(spark, tmp_path):
    reads = spark.createDataFrame([("c", i, "AC", "GT", "FF", "##", "u") for i in range(30)], "cell_id string, ordinal long, r1 string, r2 string, q1 string, q2 string, umi string")
    readers.write_fastq(reads, str(tmp_path / "fq"))
    paths = sorted(str(p) for p in (tmp_path / "fq/R1").glob("*.gz"))
    (tmp_path / "x.fastq.gz").write_bytes(b"".join(open(p, "rb").read() for p in paths))
    assert readers.read_fastq(spark, str(tmp_path / "x.fastq.gz")).count() == 30


def test_paired_reads_keep_the_number_of_their_name(spark, tmp_path):
    reads = spark.createDataFrame([("c", i, "ACG", "TT", "FFF", "FF", "u") for i in range(3)], "cell_id string, ordinal long, r1 string, r2 string, q1 string, q2 string, umi string")
    readers.write_paired_fastq(reads, str(tmp_path / "pairs"))
    (tmp_path / "x_R1.fastq").write_text("@a b\nA\n+\nF\n")
    (tmp_path / "x_R2.fastq").write_text("@a b\nA\n+\nF\n")
    first = sorted(str(p) for p in (tmp_path / "pairs").glob("*_R1.*"))
    assert sorted(r["num"] for r in readers.read_paired_fastq(spark, *first).collect()) == [0, 1, 2]
    assert readers.read_paired_fastq(spark, str(tmp_path / "x_R1.fastq")).first()["num"] is None


def test_ranges_grow_with_the_files(tmp_path):
    # A task for each few blocks would cost more than what it reads.
    path = tmp_path / "a.bam"
    path.write_bytes(bam(many_records(20_000), 2000))
    parts = formats.FastqReader({"path": f"{path},file://{path}", "split_mb": "0.0001"}).partitions()
    assert formats.RANGES / 2 < len(parts) <= formats.RANGES + 2
    for one in (parts[: len(parts) // 2], parts[len(parts) // 2 :]):
        assert one[0].start == 0 and one[-1].end is None and all(a.end == b.start for a, b in zip(one, one[1:]))
    assert formats.grown(100, 1000) == 100 and formats.grown(100, 1 << 50) == formats.USUAL and formats.grown(formats.USUAL * 2, 1 << 50) == formats.USUAL * 2


def test_batches_of_alignments_are_encoded_at_once(spark, tmp_path):
    import pyarrow as pa

    from cytoloom.sources import bam as source

    schema = pa.schema([f for f in source.SCHEMA if f.name not in ("file_id", "ordinal", "l_seq")])
    row = {"qname": "a", "flag": 16, "chrom": "r1", "pos": 7, "end_pos": 10, "mapq": None, "cigar": [{"op": "M", "len": 3}], "seq": "ACG", "qual": "AB!"}
    rows = [row, row | {"qname": "", "chrom": None, "pos": None, "end_pos": None, "cigar": None, "seq": None, "qual": None}, row | {"seq": "ACGT" * 20_000, "qual": None, "mapq": 0}, row | {"qname": "z"}]
    data, ends = source.encode(batch := pa.RecordBatch.from_pylist(rows, schema), {"r0": 0, "r1": 1})
    assert data[: ends[0]] == struct.pack("<iiiBBHHHiiii", 43, 1, 7, 2, 255, 4681, 1, 16, 3, -1, -1, 0) + b"a\0" + struct.pack("<I", 48) + bytes([0x12, 0x40, 32, 33, 0])
    assert len(ends) == 4 and data[ends[2] :] == data[: ends[0]].replace(b"a\0", b"z\0")
    path = tmp_path / "a.bam"
    path.write_bytes(b"".join(x for _, x in source.BamWriter(str(tmp_path), [["r0", 9], ["r1", 9]]).content(iter([batch.slice(0, 1), batch.slice(1)]))))
    got = readers.read_bam(spark, str(path)).orderBy("ordinal").collect()
    assert [(r["qname"], r["chrom"], r["pos"], r["seq"], r["mapq"]) for r in got] == [("a", "r1", 7, "ACG", None), ("*", None, -1, None, None), ("a", "r1", 7, "ACGT" * 20_000, 0), ("z", "r1", 7, "ACG", None)]
    for bad in ({"seq": "AxG"}, {"chrom": "r9"}, {"flag": None}, {"cigar": [{"op": "?", "len": 1}]}):
        with pytest.raises(ValueError):
            source.encode(pa.RecordBatch.from_pylist([row | bad], schema), {"r1": 0})


def test_mates_meet_by_number_without_sorting_the_records(spark, tmp_path, monkeypatch):
    def sort(*_):
        raise AssertionError("records are sorted")

    monkeypatch.setattr(readers, "numbered", sort)
    for name, n in (("a", 400), ("b", 3)):
        for mate in "12":
            (tmp_path / f"{name}_R{mate}.fq.gz").write_bytes(blocked(fastq([(f"{name}:u{i}:{i} {mate}", "ACGT"[i % 4] * int(mate), "@" * int(mate)) for i in range(n + int(mate))]), size=300))
    got = readers.read_paired_fastq(spark, *(f"file://{tmp_path}/{name}_R1.fq.gz" for name in "ab"), split_mb=0.001).collect()
    assert sorted((r["cell_id"], r["ordinal"], r["num"], r["r1"], r["r2"]) for r in got) == sorted((c, i, i, "ACGT"[i % 4], "ACGT"[i % 4] * 2) for c, n in (("a", 401), ("b", 4)) for i in range(n))
