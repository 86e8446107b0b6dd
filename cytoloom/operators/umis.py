"""Counting molecules by UMI."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from cytoloom.functions import sequence as S
from cytoloom.scratch import materialise

CODE_BITS = 16  # of an 8-base UMI


def exact_umis(umis: DataFrame, keys: list[str]) -> DataFrame:
    return umis.groupBy(*keys).agg(F.countDistinct("umi").alias("n_umis"))


def directional_umis(umis: DataFrame, keys: list[str], distance: int = 1, bits: int = CODE_BITS) -> DataFrame:
    """Molecules per key from (keys, umi, cnt): UMIs without a like UMI of higher count.

    Likeness is the number of differing bits of the two-bit codes; equal counts rank by code, so the result does not
    depend on row order.  For a distance of 1 each UMI looks up its neighbours by an equi-join on flipped bits, and a
    distance of 2 flips two; rows grow with the UMIs and never with their pairs.  UMIs with other letters than ACGT
    have no neighbours.
    """
    rows = umis.withColumn("code", S.umi_code("umi")).groupBy(*keys, "umi", "code").agg(F.sum("cnt").alias("cnt"))
    flips = [0]
    for _ in range(distance):
        flips = sorted({f ^ (1 << b) for f in flips for b in range(bits)} | set(flips))
    flips = [f for f in flips if f]
    if not flips:
        return rows.groupBy(*keys).agg(F.count("*").alias("n_umis"))
    rows = materialise(rows, "umis")  # read three times below
    total = rows.groupBy(*keys).agg(F.count("*").alias("total"))
    # Most keys have one UMI and need no lookup; one of fewer UMIs than flips meets itself, which makes fewer rows.
    several = rows.withColumn("_n", F.count("*").over(W.partitionBy(*keys))).where("_n > 1 and code is not null").drop("umi")
    other = lambda some: some.select(*keys, F.col("code").alias("near"), F.col("cnt").alias("near_cnt"))
    few, crowd = several.where(F.col("_n") <= len(flips)), several.where(F.col("_n") > len(flips))
    near = crowd.withColumn("near", F.explode(F.transform(F.array(*[F.lit(f).cast("long") for f in flips]), lambda f: F.col("code").bitwiseXOR(f))))
    met = few.join(other(few), keys).where(S.umi_bit_distance(F.col("code"), F.col("near")) <= distance)
    met = met.unionByName(near.join(other(crowd), [*keys, "near"]).select(met.columns))
    gone = met.where("near_cnt > cnt or (near_cnt = cnt and near > code)").groupBy(*keys).agg(F.countDistinct("code").alias("gone"))
    return total.join(gone, keys, "left").select(*keys, (F.col("total") - F.coalesce("gone", F.lit(0))).alias("n_umis"))
