"""Barcodes of several pools, kits, edit distances and functions over cells against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.operators import chemistry, mapcell
from cytoloom.operators.chemistry import Chemistry, Pool
from cytoloom.operators.filters import assert_sorted, filter_with_previous, islands

WHITELIST = [(1, 0, "A1", "ACGTACGT"), (1, 1, "A2", "TTTTCCCC"), (1, 2, "A3", "ACGTACGA"), (2, 0, "B1", "GGGGAAAA"), (2, 1, "B2", "CATGCATG")]
PAIR = "ordinal long, r1 string, r2 string, q1 string, q2 string, extra string"
KIT = Chemistry("k", (Pool(1, (4, 5, 3)), Pool(2, (14, 15, 13))), "r2", (0, 4), 1, 1, True, True)


def hamming(a, b):
    return sum(x != y or x == "N" for x, y in zip(a, b)) if len(a) == len(b) else 99


def assigned(r2, kit):
    total, names, cut = 0, [], 0
    for pool in kit.pools:
        found = [(hamming(r2[p : p + 8], seq), i, idx, name, p) for i, p in enumerate(pool.places) for k, idx, name, seq in WHITELIST if k == pool.pool]
        d, _, _, name, p = min(found)
        if d > kit.part:
            return None
        total, cut = total + d, max(cut, p + 8)
        names.append(name)
    if total > kit.total:
        return None
    return "_".join(names), total, r2[kit.umi[0] : kit.umi[1]], r2[cut:].lstrip("T") if kit.poly_t else r2[cut:]


def pairs(n=400):
    rng = random.Random(8)
    rows = [(-1, "A", "", "F", "", None), (-2, "A", "ACGTA", "F", "FFFFF", "x"), (-3, None, None, None, None, "y")]
    for i in range(n):
        shift, filler = rng.choice([0, 1, 1, 3]), lambda k: "".join(rng.choice("ACGTN") for _ in range(k))
        r2 = filler(3) + filler(shift) + rng.choice(WHITELIST[:3])[3] + "GT" + rng.choice(WHITELIST[3:])[3] + "TT" + filler(rng.randint(0, 9))
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(r2))
            r2 = r2[:at] + rng.choice("ACGTN") + r2[at + 1 :]
        rows.append((i, "ACGT", r2, "FFFF", "F" * len(r2), str(i)))
    return rows


@pytest.mark.parametrize("total", [0, 1, 2])
def test_pools_share_one_tolerance(spark, total):
    kit = chemistry.replace(KIT, total=total)
    whitelist = spark.createDataFrame(WHITELIST, "pool int, idx int, name string, seq string")
    got = {r["ordinal"]: r for r in chemistry.assign_cells(spark.createDataFrame(pairs(), PAIR), whitelist, kit, "lib").collect()}
    assert len(got) == len(pairs())
    accepted = 0
    for ordinal, _, r2, _, q2, extra in pairs():
        r, want = got[ordinal], assigned(r2 or "", kit)
        assert r["extra"] == extra and r["accepted"] == (want is not None)
        if want:
            accepted += 1
            assert (r["cell_id"], r["distance"], r["umi"], r["r2"]) == (f"lib_{want[0]}", *want[1:]) and len(r["q2"]) == len(r["r2"])
        else:
            assert (r["cell_id"], r["distance"], r["umi"], r["r2"], r["q2"]) == (None, None, None, r2, q2)
    assert accepted > 30
    empty = spark.createDataFrame([], PAIR)
    assert chemistry.assign_cells(empty, whitelist, kit).count() == 0
    assert chemistry.assign_cells(spark.createDataFrame(pairs(5), PAIR), whitelist.limit(0), kit).where("accepted").count() == 0


def test_places_and_kits(spark):
    whitelist = spark.createDataFrame(WHITELIST, "pool int, idx int, name string, seq string")
    reads = spark.createDataFrame([r for r in pairs(600) if r[2]], PAIR)
    histogram = {(r["pool"], r["place"]): r["hits"] for r in chemistry.place_histogram(reads, whitelist).collect()}
    want = {}
    for _, _, r2, *_ in pairs(600):
        for k, _, _, seq in WHITELIST:
            for p in range(len(r2 or "") - 7):
                if r2[p : p + 8] == seq:
                    want[k, p] = want.get((k, p), 0) + 1
    assert histogram == want
    found = chemistry.with_found_places(chemistry.replace(KIT, pools=(Pool(1, (0,)), Pool(2, (0,)), Pool(7, (1,)))), chemistry.find_places(chemistry.place_histogram(reads, whitelist)))
    assert found.pools[0].places[0] == 4 and set(found.pools[0].places) == {3, 4, 6} and found.pools[1].places[0] == 14 and found.pools[2].places == (1,)
    kits = chemistry.kits_of([{"kit": n, "bc1": "x", "bc2": "x", "bc3": "y", "umilen": u, "trim2": "30", "bc1pos": a, "bc2pos": a, "bc3pos": b} for n, u, a, b in (("good", "4", "4", "14"), ("bad", "", "40", "50"))], {"x": 1, "y": 2})
    assert kits[0].pools[2] == Pool(2, (14, 15, 13)) and kits[0].umi == (0, 4) and kits[1].umi is None and kits[0].trim == 30
    best = chemistry.vote(reads, whitelist, kits).first()
    assert best["kit"] == "good" and best["share"] > 0.3
    assert chemistry.vote(reads, whitelist, kits, 50).first()["kit"] == "good"


def least_edits(read, pattern):
    row = list(range(len(pattern) + 1))
    best = (row[-1], 0)
    for j, c in enumerate(read, 1):
        before, row = row, [0]
        for i, p in enumerate(pattern, 1):
            row.append(min(before[i - 1] + (c != p or p == "N"), before[i] + 1, row[i - 1] + 1))
        best = min(best, (row[-1], j))
    return best


@pytest.mark.parametrize("size", [1, 5, 8, 33, 64])
def test_edit_places(size):
    rng = random.Random(size)
    pattern = "".join(rng.choice("ACGT") for _ in range(size))
    reads = ["", "N" * 9, pattern, pattern[1:], "A" + pattern + "C"] + ["".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 90))) for _ in range(60)]
    for i in range(5, 65, 3):
        at = rng.randint(0, len(reads[i]))
        reads[i] = reads[i][:at] + pattern[: size // 2] + pattern[size // 2 + 1 :] + reads[i][at:]
    distance, end = chemistry.edit_places(reads, pattern)
    assert list(zip(distance.tolist(), end.tolist())) == [least_edits(r, pattern) for r in reads]
    assert [len(x) for x in chemistry.edit_places([], pattern)] == [0, 0]


def test_find_barcodes(spark):
    whitelist = spark.createDataFrame(WHITELIST, "pool int, idx int, name string, seq string").where("pool = 1")
    reads = [(0, "GGACGTACGTGG"), (1, "GGACGTCGTGG"), (2, None), (3, ""), (4, "TTTTCCC"), (5, "GGGGGGGGGG")]
    got = {r["n"]: tuple(r)[2:] for r in chemistry.find_barcodes(spark.createDataFrame(reads, "n int, seq string"), whitelist).collect()}
    assert got == {0: ("A1", 0, 0, 10), 1: ("A1", 0, 1, 9), 2: (None,) * 4, 3: (None,) * 4, 4: ("A2", 1, 1, 7), 5: (None,) * 4}


def test_a_cell_without_any_expected_file_fails(spark):
    files = spark.createDataFrame([("c1", "a", b"1"), ("c1", "b", b"2"), ("c2", "b", b"3")], "cell_id string, file_name string, content binary")
    seen = lambda held: ({"names": ",".join(sorted(held)).encode()}, "log")
    with pytest.raises(Exception, match="c2 lacks"):
        mapcell.map_cells(files, mapcell.CellFunction(seen, ("a",), "fail")).collect()
    skipped = {(r["cell_id"], r["file_name"]): bytes(r["content"]) for r in mapcell.map_cells(files, mapcell.CellFunction(seen, ("a",), "skip")).collect()}
    assert skipped["c1", "names"] == b"a,b" and skipped["c2", mapcell.LOG].startswith(b"skipped") and ("c2", "names") not in skipped
    both = mapcell.map_cells(files.where("cell_id = 'c1'"), mapcell.CellFunction(seen, ("a",), "fail")).where("file_name = 'names'").first()
    assert bytes(both["content"]) == b"a,b"


def ordered(spark, n=5000):
    rng = random.Random(1)
    cell, rows = 0, []
    for i in range(n):
        cell += rng.random() < 0.01
        rows.append(("f" if i < n - 50 else "g", i, f"c{cell:04d}" if i != 77 else None))
    return rows, spark.createDataFrame(rows, "file_id string, ordinal long, cell_id string").repartition(7)


@pytest.fixture
def ranges(spark):
    """Nine ranges, however few rows there are."""
    settings = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield 9
    for k, v in before.items():
        spark.conf.set(k, v)


def test_islands_over_borders_of_ranges(spark, ranges):
    rows, frame = ordered(spark)
    got = sorted((r["file_id"], r["first_ordinal"], r["last_ordinal"], r["n_rows"], r["cell_id"]) for r in islands(frame, ["file_id"], "ordinal", "cell_id").collect())
    kept = {r["ordinal"] for r in filter_with_previous(frame, "prev_cell_id is null or prev_cell_id <> cell_id", ["file_id"], "ordinal", ["cell_id"]).collect()}
    want, changed = [], set()
    for f, i, c in rows:
        if want and want[-1][0] == f and want[-1][4] == c:
            want[-1] = (f, want[-1][1], i, want[-1][3] + 1, c)
        else:
            want.append((f, i, i, 1, c))
    for (f, i, c), before in zip(rows, [(None, None, None), *rows]):
        if before[0] != f or before[2] is None or (c is not None and c != before[2]):
            changed.add(i)
    assert got == sorted(want, key=lambda r: r[:4]) and kept == changed
    whole = frame.where("cell_id is not null")
    assert assert_sorted(whole).count() == len(rows) - 1
    with pytest.raises(Exception, match="cell_id not sorted: f 4000"):
        assert_sorted(whole.withColumn("cell_id", F.when(F.col("ordinal") == 4000, "a").otherwise(F.col("cell_id")))).count()


def test_no_task_holds_most_of_one_file(spark, ranges):
    from cytoloom.operators.layout import with_previous

    frame = spark.range(40_000).selectExpr("'one' as file_id", "id as ordinal", "id div 9 as cell_id")
    sizes = [r["n"] for r in with_previous(frame, ["cell_id"], ["file_id"], ["ordinal"]).groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == ranges and max(sizes) < 2 * np.median(sizes)


def test_rows_that_follow_each_other_are_put_together_before_they_are_sorted(spark):
    from cytoloom.operators.filters import _stretches

    frame = spark.range(0, 40_000, 1, 4).selectExpr("'one' as file_id", "id as ordinal", "if(id % 20000 = 7, null, named_struct('a', id div 9000, 'b', if(id < 100, null, 'x'))) as at")
    assert _stretches(frame, ["file_id"], "ordinal", "at").count() < 40
    got = sorted(tuple(r) for r in islands(frame, ["file_id"], "ordinal", "at").select("first_ordinal", "last_ordinal", "n_rows").collect())
    borders = [0, 7, 8, 100, 9000, 18_000, 20_007, 20_008, 27_000, 36_000, 40_000]
    want = [(a, b - 1, b - a) for a, b in zip(borders, borders[1:])]
    assert got == want
    # Even and odd rows come apart, so stretches of one value lie over each other.
    mixed = frame.where("ordinal % 2 = 0").union(frame.where("ordinal % 2 = 1"))
    assert sorted(tuple(r) for r in islands(mixed, ["file_id"], "ordinal", "at").select("first_ordinal", "last_ordinal", "n_rows").collect()) == want


@pytest.mark.parametrize("listed", [0, 100])
def test_windows_that_are_no_barcodes_are_not_shuffled(spark, monkeypatch, listed):
    from cytoloom.operators import chemistry

    monkeypatch.setattr(chemistry, "LISTED", listed)
    reads = spark.createDataFrame([("ACGTACGTAA",), ("TTACGTACGT",), ("ACG",), (None,), ("\u00e9ACGTACGT",), ("CGTACGTA",)], "r2 string")
    whitelist = spark.createDataFrame([(1, "ACGTACGT"), (2, "ACGTACGT"), (2, "GTACGTAA"), (2, "GTACGTAA"), (3, "ACG")], "pool int, seq string")
    found = chemistry.place_histogram(reads, whitelist)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, 1), (1, 1, 1), (1, 2, 1), (2, 0, 1), (2, 1, 1), (2, 2, 2)]
    steps = found._jdf.queryExecution().sparkPlan().toString()
    # Windows meet the barcodes under the only aggregates.
    assert steps.rindex("HashAggregate") < steps.index("Join")
    empty = chemistry.place_histogram(reads, whitelist.limit(0))
    assert empty.count() == 0 and found.dtypes == empty.dtypes
