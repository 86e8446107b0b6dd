"""ZIP archives, matrices by rows, coverage summaries, reports by position and streams against plain versions."""

import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cytoloom.operators import counts, intervals, kmers
from cytoloom.sources import archives, readers
from cytoloom.streaming import counts as streams

FILES = "cell_id string, file_name string, content binary"


def cell_files(n=60):
    rng = random.Random(2)
    return [(f"c{i % 7}é", f"dir/f{i}", bytes(rng.randrange(4) for _ in range(rng.choice([0, 1, 5_000])))) for i in range(n)]


def test_zip_is_written_merged_and_read(spark, tmp_path):
    files = spark.createDataFrame(cell_files(), FILES).repartition(3)
    readers_key = lambda df: sorted((r["cell_id"], r["file_name"], bytes(r["content"])) for r in df.collect())
    archives.write_zip(files.where("file_name < 'dir/f3'"), str(tmp_path / "a"), 2)
    archives.write_zip(files.where("file_name >= 'dir/f3'"), str(tmp_path / "b"), 2)
    paths = sorted(map(str, [*(tmp_path / "a").glob("*.zip"), *(tmp_path / "b").glob("*.zip")]))
    seen = [(info.filename, z.read(info)) for p in paths for z in [zipfile.ZipFile(p)] for info in z.infolist()]
    assert sorted(seen) == sorted((f"{c}/{f}", x) for c, f, x in cell_files()) and all(zipfile.ZipFile(p).testzip() is None for p in paths)
    entries = archives.list_entries(spark.createDataFrame([(p,) for p in paths], "archive string"))
    archives.merge_zip(entries.unionByName(entries), str(tmp_path / "m"), 2)
    merged = sorted(map(str, (tmp_path / "m").glob("*.zip")))
    assert all(zipfile.ZipFile(p).testzip() is None for p in merged)
    names = [info.filename for p in merged for info in zipfile.ZipFile(p).infolist()]
    assert names == sorted(names) and len(names) == len(cell_files())
    assert readers_key(readers.read_zip(spark, str(tmp_path / "m"))) == sorted(cell_files())
    with pytest.raises(Exception, match="not a cell id"):
        archives.write_zip(files.withColumn("cell_id", F.lit("../x")), str(tmp_path / "bad"), 1)


def test_zip_of_another_writer(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.comment = b"PK"
        z.writestr("c/", b"")
        z.writestr("c/stored", b"abc", zipfile.ZIP_STORED)
        with z.open("c/streamed", "w") as f:
            f.write(b"x" * 10_000)
        z.writestr("no folder", b"1")
    got = {(r["cell_id"], r["file_name"]): bytes(r["content"]) for r in readers.read_zip(spark, str(path)).collect()}
    assert got == {("c", "stored"): b"abc", ("c", "streamed"): b"x" * 10_000}
    data = bytearray(path.read_bytes())
    data[data.find(b"abc")] ^= 1
    (tmp_path / "broken.zip").write_bytes(bytes(data))
    with pytest.raises(Exception, match="broken entry"):
        readers.read_zip(spark, str(tmp_path / "broken.zip")).collect()


def test_zip_of_many_entries(spark, tmp_path):
    files = spark.range(66_000).selectExpr("concat('c', id) as cell_id", "'f' as file_name", "cast('' as binary) as content")
    archives.write_zip(files, str(tmp_path / "z"), 1)
    (path,) = map(str, (tmp_path / "z").glob("*.zip"))
    assert len(zipfile.ZipFile(path).namelist()) == 66_000
    assert archives.list_entries(spark.createDataFrame([(path,)], "archive string")).count() == 66_000


def test_csr(spark):
    rng = random.Random(3)
    cells = {(r, c): rng.randint(1, 9) for r in range(47) for c in rng.sample(range(30), rng.randint(1, 9))}
    rows = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "row long, col long, cnt long").repartition(4)
    got = counts.csr_blocks(rows, 10).orderBy("block").collect()
    pointers, back = [], {}
    for b in got:
        pointers += b["indptr"] if not pointers else b["indptr"][1:]
        for k in range(b["n_rows"]):
            for at in range(b["indptr"][k], b["indptr"][k + 1]):
                back[b["first_row"] + k, b["indices"][at - b["indptr"][0]]] = b["data"][at - b["indptr"][0]]
        assert b["indptr"][0] == pointers[b["first_row"]]
    assert back == cells and pointers[-1] == len(cells) and len(pointers) == 48
    assert counts.csr_blocks(rows.limit(0)).count() == 0


def test_zoom_levels(spark):
    rng = random.Random(4)
    runs, at = [], 0
    for _ in range(300):
        at += rng.choice([0, 0, 7, 400])
        size = rng.randint(1, 90)
        runs.append(("x" if len(runs) < 200 else "y", at, at + size, rng.randint(1, 9)))
        at += size
    got = {(r["level"], r["chrom"], r["start"]): tuple(r)[3:] for r in intervals.zoom_levels(spark.createDataFrame(runs, "chrom string, start long, end long, bases long"), [100, 300, 1200]).collect()}
    want = {}
    for level, width in enumerate([100, 300, 1200]):
        values = {}
        for chrom, start, end, v in runs:
            for p in range(start, end):
                values.setdefault((level, chrom, p // width * width), []).append(v)
        want |= {k: (k[2] + width, len(x), min(x), max(x), sum(x), sum(v * v for v in x)) for k, x in values.items()}
    assert got == want
    with pytest.raises(ValueError, match="multiple"):
        intervals.zoom_levels(spark.createDataFrame(runs, "chrom string, start long, end long, bases long"), [100, 250])


READS = "cell_id string, r1 string, r2 string, q1 string, q2 string"


def reads_of(n=300):
    rng = random.Random(5)
    seq = lambda k: "".join(rng.choice("ACGTN") for _ in range(k))
    rows = [(f"c{rng.randrange(4)}", seq(rng.randint(0, 30)), seq(rng.randint(0, 5)), "", "") for _ in range(n)]
    rows = [(c, a, b, "".join(chr(33 + rng.randrange(40)) for _ in a), "F" * len(b)) for c, a, b, *_ in rows]
    return rows + rows[:20] + [(None, "AC", None, "II", None), ("c0", None, "", None, ""), ("odd", "ä", "x", "F", "F")]


def test_position_report(spark):
    frame = spark.createDataFrame(reads_of(), READS).repartition(3)
    want = {}
    for cell, *mates in reads_of():
        for mate, (seq, qual) in enumerate(zip(mates[:2], mates[2:]), 1):
            for pos, (base, q) in enumerate(zip(seq or "", qual or "")):
                row = want.setdefault((cell, mate, pos), [0] * 7)
                row[0] += 1
                row[1] += ord(q) - 33
                row[2 + ("ACGT".index(base) if base in "ACGT" else 4)] += 1
    got = {(r["cell_id"], r["mate"], r["pos"]): list(tuple(r)[3:]) for r in counts.position_report(frame).collect()}
    assert got == want
    levels = Counter((c, n) for (c, *_), n in Counter((c, a, b) for c, a, b, *_ in reads_of()).items())
    assert {(r["cell_id"], r["copies"]): r["n_sequences"] for r in counts.duplication_levels(frame).collect()} == levels
    assert counts.position_report(frame.limit(0)).count() == 0


def test_minhash_of_a_stream(spark, tmp_path):
    rows = [r for r in reads_of(400) if r[0] and r[1] is not None and r[2] is not None]
    frame = spark.createDataFrame(rows, READS)
    for i in range(3):
        frame.where(F.pmod(F.hash("r1"), F.lit(3)) == i).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(READS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = streams.latest_by_cell(streams.minhash_stream(stream, 5, 12, "md5"))
    key = lambda df: sorted(map(tuple, df.select("cell_id", "kmer", "copies").collect()))
    assert key(got) == key(kmers.minhash(frame, 5, 12, "md5"))
