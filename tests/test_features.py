"""Reads and molecules of features against brute force."""

import random
from collections import Counter, defaultdict

import pytest

from cytoloom.operators import features
from cytoloom.plans import queries

SF = "/root/testdata/sf0.001"


def brute(reads, genes):
    pairs = defaultdict(Counter)
    for cell, umi, chrom, pos, end, flag in reads:
        for gene, c, start, stop in genes:
            if c == chrom and start < stop and pos < stop and start < end and not flag & 4:
                pairs[gene, cell][umi] += 1
    return pairs


def molecules(umis):
    code = {u: sum("ATGC".index(b) * 4**i for i, b in enumerate(reversed(u))) for u in umis if u and not set(u) - set("ATGC")}
    return sum(not any(u in code and v in code and bin(code[u] ^ code[v]).count("1") == 1 and (umis[v], code[v]) > (umis[u], code[u]) for v in umis) for u in umis)


@pytest.mark.parametrize("repeated", [False, True])
def test_features_with_crowded_places(spark, monkeypatch, repeated):
    monkeypatch.setattr(features, "GROUP_READS", 300)  # groups are parted by cells
    rng = random.Random(5)
    reads = []
    for _ in range(1500):
        pos = rng.choice([rng.randrange(6000), 2000, -3])
        umi = rng.choice(["AAAAAAA" + rng.choice("ATGCN"), "".join(rng.choice("AT") for _ in range(8)), None])
        reads.append((rng.choice(["c1", "c2", "c3", None]), umi, rng.choice(["x", "y"]), pos, pos + rng.choice([1, 50, 3000]), rng.choice([0, 4, 16])))
    genes = [(f"g{i}", rng.choice("xyz"), s := rng.choice([700, 1400, rng.randrange(6000)]), s + rng.choice([1, 90, 500, 2500])) for i in range(120)] + [("empty", "x", 5, 5), (None, "y", 1400, 1500)]
    if repeated:
        genes += [("g3", "x", 100, 5000), ("g3", "x", 100, 5000), ("g9", "y", 0, 50)]
    a = spark.createDataFrame(reads, "cell_id string, umi string, chrom string, pos long, end_pos long, flag int")
    f = spark.createDataFrame(genes, "gene_id string, chrom string, start long, end long")
    want = brute(reads, genes)
    assert {(r[0], r[1]): r[2] for r in features.feature_reads(a, f).collect()} == {k: sum(u.values()) for k, u in want.items()}
    got = features.feature_molecules(a, f).collect()
    assert len(got) == len(want) and {(r[0], r[1]): r[2] for r in got} == {k: molecules(u) if None not in k else len(u) for k, u in want.items()}


def test_empty_tables(spark):
    a = spark.createDataFrame([], "cell_id string, umi string, chrom string, pos long, end_pos long, flag int")
    f = spark.createDataFrame([("g", "x", 0, 10)], "gene_id string, chrom string, start long, end long")
    assert features.feature_reads(a, f).count() == features.feature_molecules(a, f.where("false")).count() == 0


@pytest.mark.parametrize("name", ["count_feature_reads", "count_feature_umi"])
def test_features_need_no_row_for_each_pair(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "HashAggregate" not in plan
