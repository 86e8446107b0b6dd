"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to length 1, where cosine >= t is a distance of at most e = sqrt(2 - 2t), and turned to their
principal axes.  They are sorted by the e-wide grid cells of the leading axes and cut into sequences.  Intervals of
sequences are joined from the whole order downwards: a pair of intervals whose bounding boxes are more than e apart
is left, any other is split, until pairs of sequences remain.  A sequence then sends to each of its partners only the
vectors that are within e of the partner's box and, on the leading axes, of a vector in it; these are compared in double
precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegralType

from cytoloom.llm.components import connected_components
from cytoloom.operators.filters import small
from cytoloom.operators.layout import numbered
from cytoloom.scratch import bound_batches, materialise

#: Vectors in a sequence, leading axes that have cells, and bits by which intervals split.
SEQUENCE, AXES, SPLIT = 256, 8, 4
#: What half precision can add to a distance on the LEAD leading axes of vectors of length 1, and how many these are.
SLACK, LEAD = 1e-3, 12
#: Partners, next to each other in the order, that a sequence meets in one row.
PARTNERS = 64
#: Products this close to the threshold are worked out again from the stored components.
BORDER = 1e-9


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), float).reshape(len(vectors), -1)


def _stored(parts: list[bytes], dim: int, kind: str) -> np.ndarray:
    """Vectors from the bytes of their components."""
    return np.frombuffer(b"".join(parts), kind).astype(float).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension of vectors the axes by falling variance, from sums over all rows (at most d(d+3)/2 + 1 of them)."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, part in b.groupby("dim"):
                y = np.c_[_unit(_matrix(part["embedding"])), np.ones(len(part))]
                i, j = np.triu_indices(d + 1)
                yield pd.DataFrame({"dim": np.int32(d), "i": i.astype(np.int32), "j": j.astype(np.int32), "v": (y.T @ y)[i, j]})

    found = vectors.mapInPandas(sums, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    axes = {}
    for d, part in found.groupby("dim"):
        m = np.zeros((d + 1, d + 1))
        m[part["i"], part["j"]] = m[part["j"], part["i"]] = part["v"]
        mean = m[:-1, -1] / m[-1, -1]
        axes[int(d)] = np.linalg.eigh(m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean))[1][:, ::-1]
    return axes


def _grid(axes: dict[int, np.ndarray], cell: float, kind: str):
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, part in b.groupby("dim"):
                v = _matrix(part["embedding"])
                cells = np.floor(_unit(v) @ axes[d][:, :AXES] / cell).astype(np.int32)
                yield pd.DataFrame({"cid": part["cid"], "label": part["label"], "dim": np.int32(d), "n": part["n"], "cells": list(cells), "v": [x.tobytes() for x in v.astype(kind)]})

    return place


SEQUENCES = "label long, dim int, part int, slot long, cids binary, ns binary, v binary, low binary, high binary, lead binary"


def _sequences(axes: dict[int, np.ndarray], kind: str):
    """Consecutive rows of one label and dimension, at most SEQUENCE together, with their bounding box."""

    def made(part: pd.DataFrame, slot: int) -> pd.DataFrame:
        dim = int(part["dim"].iloc[0])
        y = _unit(_stored(part["v"].tolist(), dim, kind)) @ axes[dim]
        return pd.DataFrame({"label": [part["label"].iloc[0]], "dim": [dim], "part": [TaskContext.get().partitionId()], "slot": [slot], "cids": [part["cid"].to_numpy(np.int64).tobytes()], "ns": [part["n"].to_numpy(np.int64).tobytes()], "v": [b"".join(part["v"])], "low": [y.min(0).tobytes()], "high": [y.max(0).tobytes()], "lead": [y[:, :LEAD].astype(np.float16).tobytes()]})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot, held = 0, None
        for b in batches:
            rows = b if held is None else pd.concat([held, b], ignore_index=True)
            held = None
            turn = np.flatnonzero(np.r_[True, (np.diff(rows["label"]) != 0) | (np.diff(rows["dim"]) != 0), True])
            for a, z in zip(turn, turn[1:]):
                for s in range(a, z, SEQUENCE):
                    part = rows.iloc[s : min(z, s + SEQUENCE)]
                    if z == len(rows) and s + SEQUENCE > z:
                        held = part
                        continue
                    yield made(part, slot)
                    slot += 1
        if held is not None:
            yield made(held, slot)

    return cut


def _numbered(sequences: DataFrame) -> DataFrame:
    """Sequences with ``place``, their number in the whole order without gaps; one row a partition is broadcast."""
    parts = sequences.groupBy("part").agg(F.count("*").alias("n"))
    ahead = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("ahead"))
    return sequences.join(F.broadcast(ahead), "part").withColumn("place", F.col("ahead") + F.col("slot")).drop("part", "slot", "ahead")


def _boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Boxes of one interval after another: rows sorted by interval become one row each per batch run."""
    for b in batches:
        out = []
        for (label, dim, node), part in b.groupby(["label", "dim", "node"], sort=False):
            low, high = (np.array([np.frombuffer(x) for x in part[c]]) for c in ("low", "high"))
            out.append((label, dim, node, low.min(0).tobytes(), high.max(0).tobytes()))
        yield pd.DataFrame(out, columns=["label", "dim", "node", "low", "high"])


def _near(e: float):
    @F.pandas_udf("boolean")
    def near(low_a: pd.Series, high_a: pd.Series, low_b: pd.Series, high_b: pd.Series) -> pd.Series:
        def gap(la, ha, lb, hb):
            la, ha, lb, hb = map(np.frombuffer, (la, ha, lb, hb))
            d = np.maximum(0, np.maximum(la - hb, lb - ha))
            return float(d @ d) <= e * e

        return pd.Series([gap(*x) for x in zip(low_a, high_a, low_b, high_b)], dtype=bool)

    return near


def _levels(boxes: DataFrame) -> list[DataFrame]:
    """Bounding boxes of the sequences, and of ever longer intervals of them up to one for each label and dimension."""
    top = boxes.agg(F.max("node")).first()[0] or 0
    levels = [boxes]
    while top:
        top >>= SPLIT
        up = levels[-1].withColumn("node", F.shiftright("node", SPLIT)).repartition("label", "dim", "node").sortWithinPartitions("label", "dim", "node")
        once = materialise(up.mapInPandas(_boxes, "label long, dim int, node long, low binary, high binary"), "boxes")
        levels.append(once)
    return levels


def near_pairs(boxes: DataFrame, e: float) -> DataFrame:
    """Pairs (label, dim, a, b), a <= b, of sequences whose boxes are at most e apart, by descent through intervals."""
    near, levels = _near(e), _levels(boxes)
    keys = ["label", "dim"]
    pairs = levels[-1].select(*keys, F.col("node").alias("a")).distinct().withColumn("b", F.col("a"))
    for level in reversed(levels[:-1]):
        side = lambda c: level.select(*keys, F.shiftright("node", SPLIT).alias(c), F.col("node").alias(f"{c}_"), F.col("low").alias(f"low_{c}"), F.col("high").alias(f"high_{c}"))  # noqa: B023, E731
        split = pairs.join(side("a"), [*keys, "a"]).join(side("b"), [*keys, "b"]).where("a_ <= b_")
        pairs = materialise(split.where(near("low_a", "high_a", "low_b", "high_b")).select(*keys, F.col("a_").alias("a"), F.col("b_").alias("b")).distinct(), "intervals")
    return pairs


def _spanning(rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """A few links that connect what all links (rows[i], cols[i]) connect: each node with the least of its group."""
    ids, flat = np.unique(np.r_[rows, cols], return_inverse=True)
    a, b = np.split(flat, 2)
    least = np.arange(len(ids))
    while True:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, least[a])
        new = new[new]
        if (new == least).all():
            return [(int(ids[i]), int(ids[j])) for i, j in enumerate(least) if i != j]
        least = new


LINKED = "a long, b long, links long"
NEAR = "label long, dim int, a long, b long, first boolean, cids binary, ns binary, v binary"


def _send(axes: dict[int, np.ndarray], e: float, kind: str):
    """For each partner of a sequence its vectors that are within e of the partner's box."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                cids, ns = np.frombuffer(r.cids, np.int64), np.frombuffer(r.ns, np.int64)
                stored = np.frombuffer(r.v, kind).reshape(-1, r.dim)
                y = _unit(stored.astype(float)) @ axes[r.dim]
                out = []
                for p in r.partners:
                    low, high = np.frombuffer(p["low"]), np.frombuffer(p["high"])
                    gap = np.maximum(0, np.maximum(low - y, y - high))
                    near = np.flatnonzero((gap * gap).sum(1) <= e * e)
                    if len(near):
                        there = np.frombuffer(p["lead"], np.float16).reshape(-1, min(r.dim, LEAD)).astype(float)
                        here = y[near, :LEAD]
                        apart = (here * here).sum(1)[:, None] + (there * there).sum(1) - 2 * here @ there.T
                        near = near[apart.min(1) <= (e + SLACK) ** 2]
                    if len(near):
                        a, b = min(r.me, p["other"]), max(r.me, p["other"])
                        out.append((r.label, r.dim, a, b, r.me == a, cids[near].tobytes(), ns[near].tobytes(), stored[near].tobytes()))
                if out:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in NEAR.split(", ")])

    return send


def _hits(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of stored vectors have a cosine of at least ``threshold``."""
    product = _unit(x) @ _unit(y).T
    hit = product >= threshold
    for i, j in zip(*np.nonzero(np.abs(product - threshold) < BORDER)):
        # A power of two takes no digit away and keeps squares in range.
        a, b = (v / 2.0 ** np.frexp(np.abs(v).max())[1] for v in (x[i], y[j]))
        hit[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold
    return hit


def _compare(threshold: float, kind: str):
    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ca, cb, na, nb = (np.frombuffer(x, np.int64) for x in (r.cids_a, r.cids_b, r.ns_a, r.ns_b))
                hit = _hits(_stored([r.v_a], r.dim, kind), _stored([r.v_b], r.dim, kind), threshold)
                if r.a == r.b:
                    np.fill_diagonal(hit, False)
                counts = [(int(c), None, int(n)) for c, n in zip(ca, hit @ nb) if n]
                if r.a != r.b:
                    counts += [(int(c), None, int(n)) for c, n in zip(cb, na @ hit) if n]
                i, j = np.nonzero(hit)
                edges = [(a, b, None) for a, b in _spanning(ca[i], cb[j])] if len(i) else []
                if counts:
                    yield pd.DataFrame(counts + edges, columns=["a", "b", "links"]).astype({"a": "Int64", "b": "Int64", "links": "Int64"})

    return links


def _met(sequences: DataFrame, pairs: DataFrame, axes: dict[int, np.ndarray], e: float, kind: str) -> DataFrame:
    """The vectors of both sides of each pair that can have a partner on the other one."""
    keys = ["label", "dim"]
    sides = [pairs.select(*keys, F.col(x).alias("me"), F.col(y).alias("other")) for x, y in ("ab", "ba")]
    box = sequences.select(*keys, F.col("place").alias("other"), "low", "high", "lead")
    asks = sides[0].unionByName(sides[1].where("me <> other")).join(box, [*keys, "other"])
    lists = asks.groupBy(*keys, "me", F.floor(F.col("other") / PARTNERS).alias("some")).agg(F.collect_list(F.struct("other", "low", "high", "lead")).alias("partners"))
    rows = sequences.select(*keys, F.col("place").alias("me"), "cids", "ns", "v").join(lists, [*keys, "me"])
    near = materialise(rows.select(*keys, "me", "cids", "ns", "v", "partners").mapInPandas(_send(axes, e, kind), NEAR), "near")
    columns = ["cids", "ns", "v"]
    one = near.where("first").select(*keys, "a", "b", *[F.col(c).alias(f"{c}_a") for c in columns])
    two = near.where("not first or a = b").select(*keys, "a", "b", *[F.col(c).alias(f"{c}_b") for c in columns])
    return one.join(two, [*keys, "a", "b"]).select("dim", "a", "b", *[f"{c}_{x}" for x in "ab" for c in columns])


def _numbered_labels(vectors: DataFrame) -> DataFrame:
    """The rows with labels as longs: whole numbers as they are, others, such as texts and fractions, by their number among the distinct ones."""
    rows, kind = vectors.select("vec_id", "embedding", "label"), vectors.schema["label"].dataType
    if isinstance(kind, IntegralType):
        return rows.withColumn("label", F.col("label").cast("long"))
    numbers = small(numbered(rows.where("label is not null").select(F.col("label").alias("given")).distinct(), ["given"]))
    return rows.join(numbers, F.col("label") == F.col("given"), "left").select("vec_id", "embedding", F.col("num").alias("label"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding, label).

    Vectors are compared only under one label and in one dimension.  A null label and a vector that is null, zero, empty or
    holds null or non-finite numbers link with nothing and form a component of their own.  Equal vectors are one class
    with a count; repeated rows are members of it and link with each other.  A null vec_id has a null component unless it is
    linked; it is then named by the smallest id.
    """
    bound_batches(vectors.sparkSession)
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    number, kind = ("float", "<f4") if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else ("double", "<f8")
    rows = _numbered_labels(vectors).select("vec_id", "label", F.col("embedding").cast(f"array<{number}>").alias("embedding"), F.coalesce(good, F.lit(False)).alias("good"))
    # Two hashes stand for a label and vector, so that copies meet without their components.
    rows = rows.withColumns({"k1": F.xxhash64("label", "embedding"), "k2": F.xxhash64(F.lit(1), "embedding", "label")})
    classes = rows.where("good").groupBy("k1", "k2", "label").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "classes")
    e = math.sqrt(2 - 2 * threshold) + 1e-9
    axes = principal_axes(classes)
    placed = classes.mapInPandas(_grid(axes, e, kind), "cid long, label long, dim int, n long, cells array<int>, v binary")
    order = ["label", "dim", "cells", "cid"]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("cells")
    sequences = _numbered(materialise(ordered.mapInPandas(_sequences(axes, kind), SEQUENCES), "sequences"))
    pairs = near_pairs(sequences.select("label", "dim", F.col("place").alias("node"), "low", "high"), e)
    found = materialise(_met(sequences, pairs, axes, e, kind).mapInPandas(_compare(threshold, kind), LINKED), "found")
    counts = found.where("links is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "cid")
    known = classes.select("cid", "rep", "k1", "k2", "n").join(counts, "cid", "left").join(groups, "cid", "left").withColumn("comp", F.coalesce("component", "cid"))
    known = materialise(known.select("k1", "k2", "rep", "comp", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "known")
    least = known.groupBy("comp").agg(F.min("rep").alias("first"))
    by_class = known.join(least, "comp").select("k1", "k2", "n_links", "first")
    lone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where("good").join(by_class, ["k1", "k2"]).select("vec_id", "n_links", F.col("first").alias("component_id")).unionByName(lone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
