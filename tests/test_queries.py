"""Every registered query against its SQL in DuckDB; streams against batches."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytoloom.operators import counts, kmers
from cytoloom.plans import assays, files, queries as plans
from cytoloom.streaming.counts import histogram_stream, latest_by_cell, minhash_stream, run_to_table, sketch_stream

QUERIES, ORACLE_SQL = plans.QUERIES | files.QUERIES | assays.QUERIES, plans.ORACLE_SQL | files.ORACLE_SQL | assays.ORACLE_SQL
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    def plain(v):
        return None if v is None or pd.isna(v) else float(v) if isinstance(v, (int, float)) or hasattr(v, "__float__") and not isinstance(v, str) else v

    return sorted(map(repr, (tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_trim_overlap_takes_every_pair(spark):
    from collections import Counter

    from cytoloom.plans.views import view

    def probe_at(a, probe):
        same = lambda x, y: sum(p == q != "N" for p, q in zip(x, y))
        n = len(a)
        if n >= 32:
            good = [i for i in range(n - 31) if same(a[i : i + 8], probe[:8]) > 5]  # as the reference, not into the last 16
            full = [i for i in good if same(a[i : i + 16], probe) > 14]
            if full:
                return full[0]
            if good and same(a[good[-1] : good[-1] + 16], probe) > 13:
                return good[-1]
        for k in range(min(16, n), 0, -1):
            got = same(a[n - k :], probe[:k])
            if k > 8 and same(a[n - k :][:8], probe[:8]) > 5 and got > k - 2 or k < 8 and got >= k - 1:
                return n - k
        return None

    want, seen, short = Counter(), set(), 0
    for r in view(spark, SF, "reads").collect():
        o = 0 if r["ordinal"] % 3 == 0 else r["ordinal"] * 37 % 120
        r1, q1, n1 = r["r1"], r["q1"], len(r["r1"])
        keep = min(o, n1)
        r2 = (r1[n1 - keep :] + r["r2"])[::-1].translate(str.maketrans("ACGT", "TGCA"))
        q2 = (q1[n1 - keep :] + r["q2"])[::-1]
        n2, found = len(r2), []
        for at in (28, n2 - 16):
            start = n2 - at - 16
            if at >= 0 and start >= 0 and n1 >= 16:
                place = probe_at(r1, r2[::-1].translate(str.maketrans("ACGT", "TGCA"))[start : start + 16])
                found += [] if place is None else [(n1 - place, n1 - place + start)]
        ov = max(reversed(found), key=lambda f: f[0])[1] if found else 0  # of equal places, as the reference, that of the last probe
        if ov and n2 < ov and n1 + n2 < 44 + ov:
            continue
        e1 = n1 + n2 - ov if ov and n2 < ov else n1
        e2 = max(0, n2 - 44 + n1 - ov if ov and n1 < ov + 44 else n2)
        s2 = min(1, e2) if ov else 0
        want[r["cell_id"], r1[44:e1], r2[s2:e2], q1[44:e1], q2[s2:e2], r["umi"], ov] += 1
        seen.add(keep)
        short += n1 < 150
    got = Counter(map(tuple, QUERIES["trim_overlap"](spark, SF).select("cell_id", "r1", "r2", "q1", "q2", "umi", "overlap").collect()))
    assert got == want and short and {0, 119} <= seen


def test_results_do_not_depend_on_partitions(spark):
    from cytoloom.plans.views import view

    reads = view(spark, SF, "reads")
    for f in (counts.cell_histogram, lambda r: kmers.minhash(r, 11, 20), lambda r: kmers.count_sketch(r, 11, 64)):
        assert sorted(map(str, f(reads.repartition(1)).collect())) == sorted(map(str, f(reads.repartition(7)).collect()))


def test_streams_equal_batches(spark, tmp_path):
    rows_ = spark.createDataFrame([(f"c{i % 5}", "ACGTTGCA" * (1 + i % 3), "TTGACA") for i in range(60)], "cell_id string, r1 string, r2 string")
    rows_.repartition(6).write.parquet(str(tmp_path / "reads"))
    stream = lambda: spark.readStream.schema(rows_.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "reads"))
    for made, want in ((histogram_stream(stream()), counts.cell_histogram(rows_)), (sketch_stream(stream(), 5, 32), kmers.count_sketch(rows_, 5, 32))):
        assert sorted(map(str, run_to_table(made).collect())) == sorted(map(str, want.collect()))


    got = latest_by_cell(minhash_stream(stream(), 4, 6))
    assert sorted(map(str, got.collect())) == sorted(map(str, kmers.minhash(rows_, 4, 6).collect()))


def test_filters_part_the_rows(spark):
    a, b = (QUERIES[n](spark, SF) for n in ("filter_mapped", "filter_unmapped"))
    assert a.count() + b.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() and set(entry.oracle_sql()) <= set(entry.queries())


def test_archives_grow_with_the_table(spark):
    from cytoloom.plans.files import _archives

    assert _archives(spark.range(100, numPartitions=12), 8) == 12 and _archives(spark.range(100, numPartitions=2), 8) == 8
