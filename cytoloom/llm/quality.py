"""Quality classifier: a generalised additive model with pairwise interactions over features of the text.

Shallow trees are boosted on one feature after the other, round after round, on the logistic loss.  A tree on one
binned feature is a table over its bins, so the sum of all trees of a feature is one lookup table and a score is a
sum of lookups.  Pairs of features that explain the rest best get tables over two coarser features in the same way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cytoloom.llm.texts import map_texts
from cytoloom.scratch import bound_batches

#: Labelled rows that training uses at most: the first by a hash of doc_id.  All rows are scored.
MAX_TRAINING_ROWS = 20_000
BINS, COARSE, ROUNDS, PAIRS, RATE, RIDGE = 32, 8, 150, 6, 0.1, 5.0
FEATURES = ("words", "word_length", "upper", "digits", "exclamation", "pipes", "symbols", "stops", "commas", "brackets", "high_bytes", "line_length", "distinct_words", "top_word", "stutter", "repeated_lines", "symbol_words")


def _class(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8)).astype(float)


CLASSES = np.stack([_class(c) for c in (bytes(range(65, 91)), b"0123456789", b"!", b"|", b"#$%&*<>=@^~\\{}_", b".", b",;", b"()[]", bytes(range(128, 256)), b"\n")], 1)
LETTERS = _class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def text_features(text: str | None) -> np.ndarray:
    """FEATURES of a whole text; a null or empty text has zeros."""
    raw = (text or "").encode()
    if not raw:
        return np.zeros(len(FEATURES))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1.0, counts @ LETTERS)
    upper, *shares = counts @ CLASSES
    words = raw.lower().split()
    n, lines = max(1, len(words)), [x for x in raw.split(b"\n") if x]
    each = Counter(words)
    odd = sum(v for w, v in each.items() if w[-1:] in b"%$&*#!|")
    return np.array([np.log1p(len(words)), len(raw) / n, upper / letters, *(s / len(raw) for s in shares[:-1]), np.log1p(len(raw) / (1 + shares[-1])), len(each) / n, max(each.values(), default=0) / n, sum(map(eq, words, words[1:])) / n, 1 - len(set(lines)) / max(1, len(lines)), odd / n])


def features_of(texts: Sequence[str | None]) -> np.ndarray:
    return np.stack([text_features(t) for t in texts]) if len(texts) else np.zeros((0, len(FEATURES)))


@dataclass
class AdditiveModel:
    """Edges of the bins of each feature, a table for each, and for each pair a table over coarse bins."""

    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    base: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        for (i, j), table in self.pairs.items():
            total += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """The best place to cut a row of bins in two, and what it gains."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    at = int(np.argmax(gains)) if len(gains) else 0
    return at + 1, float(gains[at]) if len(gains) else 0.0


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two on one feature, as a table over its bins."""
    table, at = np.zeros(len(g)), _cut(g, h)[0]
    for a, b in ((0, at), (at, len(g))):
        inner = a + _cut(g[a:b], h[a:b])[0] if b - a > 1 else b
        for c, d in ((a, inner), (inner, b)):
            if d > c:
                table[c:d] = g[c:d].sum() / (h[c:d].sum() + RIDGE)
    return RATE * table


def _tree2(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A cut on the first feature and one on the second on either side of it; the table and its gain."""
    best, best_gain = np.zeros_like(g), -np.inf
    for at in range(1, len(g)):
        table, gain = np.zeros_like(g), 0.0
        for a, b in ((0, at), (at, len(g))):
            sg, sh = g[a:b].sum(0), h[a:b].sum(0)
            cut = _cut(sg, sh)[0]
            for c, d in ((0, cut), (cut, g.shape[1])):
                if d > c:
                    gain += float(_gain(sg[c:d].sum(), sh[c:d].sum()))
                    table[a:b, c:d] = sg[c:d].sum() / (sh[c:d].sum() + RIDGE)
        if gain > best_gain:
            best, best_gain = table, gain
    return RATE * best, best_gain


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Train on features and 0/1 labels.  Without rows every score is 0.5; with one label only, near that label."""
    model = AdditiveModel()
    n = len(y)
    for j in range(x.shape[1]):
        cuts = lambda k: np.unique(np.quantile(x[:, j], np.arange(1, k) / k)) if n else np.zeros(0)  # noqa: B023, E731
        model.edges.append(cuts(BINS))
        model.coarse.append(cuts(COARSE))
        model.tables.append(np.zeros(len(model.edges[-1]) + 1))
    if not n:
        return model
    model.base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    if y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]
    total = np.full(n, model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = slopes()
            k = len(model.tables[j])
            step = _tree(np.bincount(b, g, k), np.bincount(b, h, k))
            model.tables[j] += step
            total += step[b]
    grids = {(i, j): (rough[i] * (len(model.coarse[j]) + 1) + rough[j], (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for i in range(len(bins)) for j in range(i + 1, len(bins))}

    def tree2(cell: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, float]:
        g, h = slopes()
        k = shape[0] * shape[1]
        return _tree2(np.bincount(cell, g, k).reshape(shape), np.bincount(cell, h, k).reshape(shape))

    best = sorted(grids, key=lambda ij: -tree2(*grids[ij])[1])[:PAIRS]
    for _ in range(ROUNDS // 5):
        for ij in best:
            step, _gained = tree2(*grids[ij])
            model.pairs[ij] = model.pairs.get(ij, 0) + step
            total += step.ravel()[grids[ij][0]]
    return model


def in_fold(doc_id) -> F.Column:
    """Whether a document is held out: crc32 of its id as text leaves 1 when divided by 3; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> AdditiveModel:
    """Fit on labelled documents outside the fold.

    Null labels and documents with contradicting labels are left out, repeated equal labels count once.  At most
    ``most`` labelled ids are used, those first by a hash, and as many rows of documents; these come to the driver as features, not texts.
    """
    bound_batches(docs.sparkSession)
    known = labels.where(~in_fold(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "x": list(features_of(b["text"]))})

    found = texts.mapInPandas(rows, "doc_id long, quality int, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(most).toPandas()
    x = np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, (found["quality"].to_numpy() > 0).astype(float))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Null and empty texts are scored as texts whose features are all zero, long ones whole.  Repeated rows give repeated,
    equal rows; a null doc_id stays null and is not held out.  Other columns of both tables are ignored.
    """
    model = train(docs, labels)

    def scores(texts: list[str | None]) -> list[tuple]:
        return list(enumerate(map(float, model.score(features_of(texts)))))

    scored = map_texts(docs, lambda: scores, "score double")
    return scored.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that score ``least`` or more, with the columns they came with; repeated rows stay or go together."""
    model = train(docs, labels)

    @F.pandas_udf("double")
    def quality(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(features_of(text)))

    return docs.where(quality("text") >= least)
