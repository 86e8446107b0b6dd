"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, and the groups they form.

The rarest shingles of a document come first.  Two sets with Jaccard similarity t or more share one of their first
n - ceil(t n) + 1 shingles, so only these prefixes are indexed.  Length and position turn down most pairs that meet in
the index.  The suffix filter then parts both sets at the same pivots of the hash order, half by half six times; what the
sizes of their parts differ by, they differ by at least.  What is left is verified on the full sets, no pair twice.

Groups of copies do not become all their pairs.  Equal sets are one class from the start.  Where many classes share a
shingle, each meets a bounded number of neighbours first; once those links have formed groups, only classes that are
still in different groups meet, until every remaining pair has been verified.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cytoloom.llm.components import connected_components, joined_components
from cytoloom.llm.shingles import mix, shingle_sets
from cytoloom.llm.texts import map_texts
from cytoloom.operators.filters import small
from cytoloom.scratch import bound_batches, materialise

#: Counters of the frequency sketch, as a power of two: 4 MB when it is broadcast, whatever the input.
SKETCH_BITS = 22
BLOCK_BITS = 12
#: Classes before it in a posting list that a class meets in the first rounds.
NEIGHBOURS = 8
#: Rounds with bounded neighbours after the first, before the remaining pairs are all taken.
MORE_ROUNDS = 2
#: Parts of the suffix filter: six halvings of the hashes' range, a power of two.
CUTS = 64
#: So many classes (24 bytes each) are broadcast to pick their texts; more are joined by shuffle.
BROADCAST_CLASSES = 4_000_000
#: Keys of documents a task remembers to index a set once; more copies only cost repeated index rows.
REMEMBERED = 100_000
SIGNED = np.int64
AGAIN = 0x9E3779B97F4A7C15
PIVOTS = np.arange(CUTS, dtype=np.uint64) * np.uint64(2**64 // CUTS)


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """The logarithm of how many documents hold the shingles of each counter, over all documents."""
    counters, block = 1 << SKETCH_BITS, 1 << BLOCK_BITS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(counters, np.uint32)
        for b in batches:
            held: list[np.ndarray] = []
            for s in shingle_sets(b["text"], k):
                held.append(s >> np.uint64(64 - SKETCH_BITS))
                if sum(map(len, held[-64:])) > 1 << 18 or len(held) >= 256:
                    np.add.at(total, np.concatenate(held).astype(np.int64), 1)
                    held = []
            if held:
                np.add.at(total, np.concatenate(held).astype(np.int64), 1)
        parts = total.reshape(-1, block)
        used = np.flatnonzero(parts.any(1))
        for some in np.array_split(used, max(1, len(used) // 64)):
            yield pd.DataFrame({"block": some.astype(np.int32), "counts": [zlib.compress(parts[i].tobytes(), 1) for i in some]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b["block"], b["counts"], strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(zlib.decompress(c), np.uint32).astype(np.uint64)
        yield pd.DataFrame({"block": list(total), "levels": [np.minimum(255, np.round(4 * np.log2(1.0 + c))).astype(np.uint8).tobytes() for c in total.values()]}).astype({"block": "int32"})

    parts = docs.select("text").mapInPandas(count, "block int, counts binary").repartition("block")
    levels = np.zeros((counters // block, block), np.uint8)
    for row in parts.mapInPandas(add, "block int, levels binary").toLocalIterator():
        levels[row["block"]] = np.frombuffer(row["levels"], np.uint8)
    return levels.ravel()


def _needed(n, num: int, den: int):
    """The least overlap that a set of n needs with any set similar to it: ceil(n num / den)."""
    return (n * num + den - 1) // den


def _profile(docs: DataFrame, k: int, num: int, den: int, levels: np.ndarray) -> DataFrame:
    """Per document its text's hash, its set's size n and key; where the task sees the key first, also prefix and parts."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def make():
        level, seen = shared.value, OrderedDict()

        def profile(texts: list[str | None]) -> list[tuple]:
            out = []
            for place, s in enumerate(shingle_sets(texts, k)):
                n = len(s)
                key = int((mix(s + np.uint64(n)).sum(dtype=np.uint64) ^ np.uint64(n)).astype(SIGNED)) if n else None
                again = int(mix(s ^ np.uint64(AGAIN)).sum(dtype=np.uint64).astype(SIGNED))
                prefix = cuts = None
                if n and key not in seen:
                    seen[key] = None
                    if len(seen) > REMEMBERED:
                        seen.popitem(last=False)
                    # s is sorted, so a stable sort by level is a sort by (level, hash)
                    order = np.argsort(level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                    prefix = s[order[: n - _needed(n, num, den) + 1]].view(SIGNED)
                    cuts = np.minimum(65535, np.diff(np.searchsorted(s, PIVOTS), append=n)).astype("<u2").tobytes()
                out.append((place, n, key, again, prefix, cuts))
            return out

        return profile

    named = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("doc_id"), "text")
    return map_texts(named, make, "n long, key long, again long, prefix array<long>, cuts binary").select("doc_id.*", "n", "key", "again", "prefix", "cuts")


def _told_apart(profile: DataFrame) -> DataFrame:
    """The profile with other keys where two sets share one, which is rare below some billions of sets; a second sum tells."""
    sums = profile.where("key is not null").groupBy("key").agg(F.min(F.struct("n", "again")).alias("a"), F.max(F.struct("n", "again")).alias("b"))
    clashes = materialise(sums.where("a <> b").select("key", F.lit(True).alias("clash")), "clashes")
    if clashes.isEmpty():
        return profile.drop("again")
    met = profile.join(clashes, "key", "left").withColumn("key", F.when(F.col("clash"), F.xxhash64(F.lit(1), "key", "n", "again")).otherwise(F.col("key")))
    return materialise(met.select("doc_id", "text_key", "n", "key", "prefix", "cuts"), "profile")


def _fits(na, nb, pa, pb, num: int, den: int):
    """Length and position: whether sets of these sizes that first meet at these places can overlap enough."""
    need = (num * (na + nb) + num + den - 1) // (num + den)
    return (np.minimum(na, nb) * den >= np.maximum(na, nb) * num) & (1 + np.minimum(na - pa - 1, nb - pb - 1) >= need)


def _meet(num: int, den: int):
    """Pairs of each class with the NEIGHBOURS before it in its list; lists longer than that are named."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail: pd.DataFrame | None = None
        for b in batches:
            fresh = 0 if tail is None else len(tail)
            rows = b if tail is None else pd.concat([tail, b], ignore_index=True)
            token, key, n, pos, group = (rows[c].to_numpy() for c in ("token", "key", "n", "pos", "comp"))
            found: list[np.ndarray] = []
            for w in range(1, NEIGHBOURS + 1):
                i = np.arange(max(w, fresh), len(rows))
                j = i - w
                good = (token[i] == token[j]) & (group[i] != group[j])
                i, j = i[good], j[good]
                good = _fits(n[i], n[j], pos[i], pos[j], num, den)
                i, j = i[good], j[good]
                found.append(np.stack([np.minimum(key[i], key[j]), np.maximum(key[i], key[j])], 1))
            both = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            i = np.arange(max(NEIGHBOURS + 1, fresh), len(rows))
            long_ = np.unique(token[i[token[i] == token[i - NEIGHBOURS - 1]]])
            yield pd.DataFrame({"a": np.r_[both[:, 0], np.zeros(len(long_), np.int64)], "b": np.r_[both[:, 1], np.zeros(len(long_), np.int64)], "long_token": pd.array([None] * len(both) + list(long_), dtype="Int64")})
            tail = rows.tail(NEIGHBOURS + 1)

    return pairs


def _meet_once(num: int, den: int):
    """_meet over lists in which a class may come several times in a row: it is kept once.

    The first and the last list of a range may go on in the next one, so they are named as long ones.
    """
    meet = _meet(num, den)

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[int, int] | None = None
        for b in batches:
            token, key = b["token"].to_numpy(), b["key"].to_numpy()
            new = np.r_[True, (token[1:] != token[:-1]) | (key[1:] != key[:-1])] if len(b) else np.zeros(0, bool)
            if len(b) and last == (token[0], key[0]):
                new[0] = False
            if len(b):
                last = (token[-1], key[-1])
            yield b[new]

    def with_borders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends: list[int] = []

        def watched() -> Iterator[pd.DataFrame]:
            for b in once(batches):
                if len(b):
                    ends[:] = [ends[0] if ends else int(b["token"].iloc[0]), int(b["token"].iloc[-1])]
                yield b

        yield from meet(watched())
        if ends:
            yield pd.DataFrame({"a": 0, "b": 0, "long_token": pd.array(sorted(set(ends)), dtype="Int64")})

    return with_borders


def _verify(k: int, num: int, den: int):
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()
        for b in batches:
            for some in np.array_split(np.arange(len(b)), max(1, len(b) // 256)):
                part = b.iloc[some]
                new = {key: z for side, text in (("a", "za"), ("b", "zb")) for key, z in zip(part[side], part[text]) if key not in known}
                held = {key: known[key] for side in ("a", "b") for key in part[side] if key in known}
                held |= zip(new, shingle_sets((zlib.decompress(z).decode() for z in new.values()), k))
                keep = []
                for x, y in zip(part["a"], part["b"]):
                    sx, sy = held[x], held[y]
                    same = len(np.intersect1d(sx, sy, assume_unique=True))
                    keep.append(den * same >= num * (len(sx) + len(sy) - same))
                known |= held
                while len(known) > 512:
                    known.popitem(last=False)
                yield part.loc[np.array(keep, bool), ["a", "b"]]

    return check


def _parts_allow(num: int, den: int):
    def allow(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(c), "<u2").reshape(-1, CUTS).astype(np.int64) for c in (a, b))
        nx, ny = x.sum(1), y.sum(1)
        need = (num * (nx + ny) + num + den - 1) // (num + den)
        full = (x.max(1, initial=0) >= 65535) | (y.max(1, initial=0) >= 65535)
        return pd.Series((np.minimum(x, y).sum(1) >= need) | full)

    return F.pandas_udf(allow, "boolean")


def similar_groups(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row, where links are verified pairs of distinct sets.

    ``similarity`` is a fraction of integers and is compared exactly.  Null and blank texts have no shingles and link
    with nothing, not even with each other; shorter texts are one shingle.  Rows that share a
    doc_id are judged each by its own text.  A null doc_id with a text of its own has a null component.  ``n_links`` counts the verified links of a row's class, among
    those that were needed to find the groups.  Other columns are ignored.
    """
    return _grouped(docs, words, similarity).drop("text_key")


def _grouped(docs: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """similar_groups with text_key, the hash of a row's text."""
    num, den = similarity
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    profile = _told_apart(materialise(_profile(docs, words, num, den, _sketch(docs, words)), "profile"))
    named = F.struct("doc_id", "text_key")
    classes = materialise(profile.where("key is not null").groupBy("key", "n").agg(F.min("doc_id").alias("first"), F.min(named).alias("rep"), F.max("cuts").alias("cuts")), "classes")
    posts = profile.where("prefix is not null").select("key", "n", F.posexplode("prefix").alias("pos", "token"))
    # Ranges of lists sorted by size, each class once in a list.  A list that goes over the border of a range is crowded.
    listed = posts.withColumn("comp", F.col("key")).repartitionByRange("token", "n", "key").sortWithinPartitions("token", "n", "key")
    met = materialise(listed.mapInPandas(_meet_once(num, den), "a long, b long, long_token long"), "met")
    tried = materialise(met.where("long_token is null").select("a", "b").distinct(), "tried")
    long_tokens = met.where("long_token is not null").select(F.col("long_token").alias("token")).distinct()
    crowded = materialise(posts.join(small(long_tokens), "token").distinct(), "crowded")
    wanted = materialise(tried.select(F.explode(F.array("a", "b")).alias("key")).unionByName(crowded.select("key")).distinct().join(classes, "key").select("key", "rep", "cuts"), "wanted")
    texts = _texts(docs, wanted)
    check = _verify(words, num, den)

    def verified(some: DataFrame) -> DataFrame:
        side = lambda c: wanted.select(F.col("key").alias(c), F.col("cuts").alias(f"cuts_{c}"))
        likely = some.join(side("a"), "a").join(side("b"), "b").where(_parts_allow(num, den)("cuts_a", "cuts_b")).select("a", "b")
        text = lambda c: texts.select(F.col("key").alias(c), F.col("z").alias(f"z{c}"))
        return materialise(likely.join(text("a"), "a").join(text("b"), "b").select("a", "b", "za", "zb").mapInPandas(check, "a long, b long"), "verified")

    links = verified(tried)
    groups = materialise(connected_components(links), "groups")
    if not crowded.isEmpty():
        for turn in range(MORE_ROUNDS + 1):
            placed = crowded.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("component", "key")).drop("component")
            sizes = placed.groupBy("token", "comp").agg(F.count("*").alias("m"))
            main = sizes.groupBy("token").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("m").alias("listed")).where("comps > 1").drop("comps")
            open_ = materialise(placed.join(small(main), "token"), "open")
            if open_.isEmpty():
                break
            if turn < MORE_ROUNDS:
                dealt = ["token", F.xxhash64(F.lit(turn), F.col("key"))]
                some = open_.repartitionByRange(*dealt).sortWithinPartitions(*dealt).mapInPandas(_meet(num, den), "a long, b long, long_token long").where("long_token is null").select("a", "b")
            else:
                some = _every_pair(open_, num, den)
            some = materialise(some.distinct().join(tried, ["a", "b"], "left_anti"), "some")
            if some.isEmpty():
                continue
            tried = tried.unionByName(some)
            fresh = verified(some)
            links = links.unionByName(fresh)
            groups = joined_components(groups, fresh)
    ends = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n_links"))
    by_class = classes.drop("cuts", "rep").join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("component", "key"))
    return _by_document(profile.drop("prefix", "cuts"), by_class.drop("component"), ends)


#: Members of a crowded list that one task meets with those outside its main group.
SLICE = 2_000


def _every_pair(open_: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs of one list and different groups that length and position allow; one of each is outside the main group."""
    # A list is cut into slices, and those outside the main group are sent to each.
    slices = F.ceil(F.col("listed") / SLICE)
    few = open_.where("comp <> main").select("token", *[F.col(c).alias(f"{c}_") for c in ("key", "n", "pos", "comp")], F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("slice"))
    open_ = open_.withColumn("slice", F.pmod(F.xxhash64("key"), slices))
    need = f"({num} * (n + n_) + {num + den - 1}) div {num + den}"
    fits = f"comp <> comp_ and least(n, n_) * {den} >= greatest(n, n_) * {num} and 1 + least(n - pos - 1, n_ - pos_ - 1) >= {need}"
    return few.join(open_, ["token", "slice"]).where(fits).select(F.least("key", "key_").alias("a"), F.greatest("key", "key_").alias("b"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, z): the packed text of one document of each wanted class."""
    reps = wanted.select("key", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("text_key"))
    many = reps.count()
    reps = F.broadcast(reps) if many <= BROADCAST_CLASSES else reps

    @F.pandas_udf("binary")
    def packed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: zlib.compress((t or "").encode(), 1))

    own = docs.withColumn("text_key", F.xxhash64("text"))
    met = own.join(reps, (own["text_key"] == reps["text_key"]) & own["doc_id"].eqNullSafe(reps["rep_id"]))
    return materialise(met.select("key", packed("text").alias("z")).dropDuplicates(["key"]), "texts")


def _by_document(profile: DataFrame, by_class: DataFrame, ends: DataFrame) -> DataFrame:
    """Components by class key become components by smallest doc_id, and rows that share a doc_id share one."""
    least = by_class.groupBy("comp").agg(F.min("first").alias("first"))
    named = by_class.drop("first").join(least, "comp").join(ends, "key", "left").select("key", F.col("n").alias("n_"), "first", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = profile.join(named, (profile["key"] == named["key"]) & (profile["n"] == named["n_"]), "left").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return rows


#: A column of the join below that no table brings along.
KEY = "_text_key_of_row"


def one_of_each(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """The documents with one of each near-duplicate group, that of the smallest doc_id, and all other documents.

    All columns stay.  Of rows of one group that repeat its doc_id one is kept, the first by a hash of its text; a
    document of another group or without shingles stays, whatever its id.  Documents with a null doc_id all stay.
    """
    groups = materialise(_grouped(docs, words, similarity).where("doc_id is not null and n_shingles > 0").select("doc_id", "text_key", "component_id"), "groups")
    gone = groups.where("doc_id <> component_id").select("doc_id", "text_key").distinct()
    first = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("text_key").alias("kept_key")).where("rows > 1")
    keyed = docs.withColumns({KEY: F.xxhash64("text")})
    same = lambda ids: (keyed["doc_id"] == ids["doc_id"]) & (keyed[KEY] == ids["text_key"])
    repeated = materialise(first, "repeated")
    if repeated.isEmpty():
        gone = small(gone)
        return keyed.join(gone, same(gone), "left_anti").select(docs.columns)
    # Rows that repeat the id of their group: all go, and one comes back.
    again = groups.where("doc_id = component_id").select("doc_id", "text_key").distinct().join(repeated, "doc_id")
    dropped = small(gone.unionByName(again.select("doc_id", "text_key")).distinct())
    back = small(again.where("text_key = kept_key").select("doc_id", "text_key"))
    kept = keyed.join(dropped, same(dropped), "left_anti").select(docs.columns)
    one = keyed.join(back, same(back), "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return kept.unionByName(one)
