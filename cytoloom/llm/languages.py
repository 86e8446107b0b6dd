"""Language identification by mixture inference.

Each language is a distribution over trigrams of letters, counted over all documents that may be learned from.  A
document is taken as a mixture of languages: expectation-maximisation estimates the proportions from the likelihoods of
its trigrams, for sets of one, two and more languages, and the set with the best penalised likelihood is kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cytoloom.llm.texts import map_texts
from cytoloom.scratch import bound_batches

#: Trigrams are hashed into so many bins; more languages than BYTES / (4 BINS) halve the bins, so the model never grows beyond BYTES.
BINS, BYTES = 1 << 16, 64 << 20
#: What each bin counts besides what was seen, steps of the expectation-maximisation, and characters that are looked at at once.
PRIOR, STEPS, PIECE = 0.5, 25, 1 << 19
#: A trigram overlaps two more, so its likelihood counts as a third of an independent draw.
OVERLAP = 3
UNKNOWN = "und"
SCHEMA = "lang_pred string, score double, languages array<string>, shares array<double>"


@cache
def _letters() -> np.ndarray:
    """1 for letters and 2 for the marks written on them, by code point."""
    kinds = np.fromiter((c.isalpha() for c in map(chr, range(sys.maxunicode + 1))), np.uint8, sys.maxunicode + 1)
    for i in range(0x20000):
        if unicodedata.category(chr(i))[0] == "M":
            kinds[i] = 2
    return kinds


def _pieces(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """(place, text) in lists of about PIECE characters; a longer text is cut, and each cut counts as the border of a word."""
    held, size = [], 0
    for place, text in enumerate(texts):
        for start in range(0, len(text or ""), PIECE):
            part = text[start : start + PIECE]
            held.append((place, part))
            size += len(part)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def trigrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the text, bin) of each letter with its neighbours in lower case, and the places of texts that have letters.

    What is no letter parts words; a word's borders count as a neighbour.
    """
    for pieces in _pieces(texts):
        low = [text.lower() for _, text in pieces]
        lengths = np.fromiter(map(len, low), np.int64, len(low)) + 1
        codes = np.frombuffer(("\n".join(["", *low]) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _letters()[codes]
        owner = np.concatenate([[-1], np.repeat(np.fromiter((k for k, _ in pieces), np.int64, len(pieces)), lengths)])
        word = kinds > 0
        kept = word.copy()
        kept[1:] |= word[:-1]
        kept[0] = True
        x = np.where(word, codes, 0)[kept].astype(np.uint32)
        h = x[:-2] * np.uint32(73856093) ^ x[1:-1] * np.uint32(19349663) ^ x[2:] * np.uint32(83492791)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        centre = x[1:-1] > 0
        yield owner[kept][1:-1][centre], (h[centre] >> np.uint32(16)).astype(np.int64), np.unique(owner[kinds == 1])


@dataclass
class LanguageModel:
    """Names in order, the logarithm of each language's share of the documents, and of the probability of each bin."""

    names: list[str]
    prior: np.ndarray
    logs: np.ndarray


def held_out(doc_id) -> F.Column:
    """Whether nothing is learned from a document: crc32 of its id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(lang, bin, cnt) over all documents that are not held out and have a language; bin -1 counts documents."""
    bound_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), "text")
    schema = pa.schema([("lang", pa.string()), ("bin", pa.int32()), ("cnt", pa.int64())])

    def flushed(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            bins = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins), pa.string()), pa.array(bins - 1, pa.int32()), pa.array(counts[bins])], schema=schema)
        held.clear()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[str, np.ndarray] = defaultdict(lambda: np.zeros(BINS + 1, np.int64))
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in set(langs):
                mine = [t for name, t in zip(langs, texts) if name == lang]
                held[lang][0] += len(mine)
                for _, bins, _ in trigrams(mine):
                    held[lang][1:] += np.bincount(bins, minlength=BINS)
                if len(held) >= 64:
                    yield from flushed(held)
        yield from flushed(held)

    return known.mapInArrow(rows, "lang string, bin int, cnt long").groupBy("lang", "bin").agg(F.sum("cnt").alias("cnt"))


def train(docs: DataFrame) -> LanguageModel:
    """The model of all learnable documents; the driver gets one number for each language and bin, at most BYTES / 4."""
    found = count_trigrams(docs).toPandas()
    names = sorted(found["lang"].unique())
    bins = BINS
    while len(names) * bins * 4 > BYTES and bins > 1:
        bins //= 2
    counts, documents = np.zeros((len(names), bins)), np.zeros(len(names))
    place = np.searchsorted(np.array(names, object), found["lang"].to_numpy()) if names else np.zeros(0, int)
    whole = found["bin"].to_numpy() < 0
    np.add.at(documents, place[whole], found["cnt"].to_numpy()[whole])
    np.add.at(counts, (place[~whole], found["bin"].to_numpy()[~whole] * bins // BINS), found["cnt"].to_numpy()[~whole])
    logs = np.log(counts + PRIOR) - np.log(counts.sum(1, keepdims=True) + PRIOR * bins)
    return LanguageModel(names, np.log((documents + 1) / (documents.sum() + len(names))), logs.astype(np.float32))


def mixture(logs: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Proportions of the rows of ``logs`` (languages by trigrams) that make ``counts`` likely, and the logarithm of that likelihood."""
    top = logs.max(0)
    p = np.exp(logs - top)
    shares, n = np.full(len(p), 1 / len(p)), counts.sum()
    for _ in range(steps):
        shares = shares * (p @ (counts / (shares @ p))) / n
    return shares, float(counts @ (np.log(shares @ p) + top))


def _choose(model: LanguageModel, bins: np.ndarray, counts: np.ndarray) -> tuple[list[int], np.ndarray, float]:
    """The set of languages with the best penalised likelihood, their proportions, and how likely the first is by itself.

    By concavity no mixture beats the best single language by more than the steepest of the slopes away from it; where that
    stays under the penalty nothing is searched.  Otherwise the languages join in the order of their proportions among all.
    """
    logs, n = model.logs[:, bins].astype(float), counts.sum()
    single = logs @ counts / OVERLAP + model.prior
    best = int(np.argmax(single))
    certain = float(1 / np.exp(single - single[best]).sum())
    penalty = np.log(n / OVERLAP + 1) / 2 * OVERLAP
    steepest = (np.exp(np.minimum(logs - logs[best], 600)) @ counts).max() - n
    if len(logs) == 1 or steepest <= penalty:
        return [best], np.ones(1), certain
    ranked = np.argsort(-mixture(logs, counts)[0], kind="stable")
    chosen, shares, value = [best], np.ones(1), float(logs[best] @ counts)
    for k in range(2, len(ranked) + 1):
        tried = ranked[:k]
        proportions, likelihood = mixture(logs[tried], counts)
        if likelihood - penalty * (k - 1) <= value:
            break
        chosen, shares, value = tried.tolist(), proportions, likelihood - penalty * (k - 1)
    return chosen, shares, certain


def identify(model: LanguageModel, texts: list[str | None]) -> list[tuple]:
    """(place, language, score, languages, shares) for each text; the score is the language's share, or its probability if it is alone."""
    bins, fold = model.logs.shape[1], BINS // max(1, model.logs.shape[1])
    keys, lettered = [np.zeros(0, np.int64)], set()
    for owner, grams, with_letters in trigrams(texts):
        keys.append(owner * bins + grams // fold)
        lettered.update(with_letters.tolist())
    found, counts = np.unique(np.concatenate(keys), return_counts=True)
    borders = np.searchsorted(found, np.arange(len(texts) + 1) * bins)
    out = []
    for place in range(len(texts)):
        a, z = borders[place], borders[place + 1]
        if place not in lettered or not model.names:
            out.append((place, UNKNOWN, 0.0, [], []))
            continue
        chosen, shares, certain = _choose(model, found[a:z] - place * bins, counts[a:z].astype(float))
        order = np.lexsort((chosen, -shares))
        names, parts = [model.names[chosen[k]] for k in order], shares[order].tolist()
        out.append((place, names[0], min(1.0, certain if len(names) == 1 else parts[0]), names, parts))
    return out


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages and shares for every row of ``docs``.

    Learned from text and lang of documents that are not held out; lang, source and doc_id are no input of a prediction.
    A null text, or one without a letter, is ``und`` with score 0 and no languages, and so is every text if nothing could be
    learned.  Ties go to the language with more documents, then to the smaller name.  Long texts are read whole, repeated rows
    give equal rows, a null id is not held out, and other columns are ignored.
    """
    model = train(docs)
    predicted = map_texts(docs, lambda: lambda texts: identify(model, texts), SCHEMA)
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages", "shares")
