"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source starts with the same copy probability, the source's target divided by its size.
Whole copies are granted at once.  What is left is a fraction per document; two fractional documents trade
words at random until one of them is integral, so that the words taken from a source never move by more than
one document from its target.  Long documents trade first, so the one left over tends to be short.  Trades run inside small buckets; a bucket hands on its one unfinished document
and the buckets of a source are combined by a tree of fan-in ``FAN_IN``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cytoloom.operators.layout import numbered
from cytoloom.scratch import materialise

FAN_IN = 64
#: A table of sources up to this many rows (under 10 MB) is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000
SPACE = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """How many runs of characters other than space and ``\\x09-\\x0D`` the text has; 0 for null."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> tuple[DataFrame, int, int]:
    """Per source: rows, source_size and target; besides, how many sources there are and the rows of the largest.

    Sources rank by code point with null last and take ``weights`` in turn.  The level of the water is found by repeated one-row sums.
    """
    found = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = numbered(found, [F.col("source").asc_nulls_last()], name="rank")
    ranked = materialise(ranked.withColumn("weight", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int"))), "ranked")
    limit = F.lit(float(most)) * F.col("source_size")
    n, largest, words, level = ranked.agg(F.count("*"), F.max("rows"), F.sum("source_size"), F.lit(0.0)).first()
    full = -1
    while words:
        capped = limit < F.lit(level) * F.col("weight")
        count, taken, open_weight = ranked.agg(F.count(F.when(capped, 1)), F.coalesce(F.sum(F.when(capped, limit)), F.lit(0.0)), F.sum(F.when(~capped, F.col("weight")))).first()
        if count == full or not open_weight:
            break
        full, level = count, (share * words - taken) / open_weight
    return ranked.withColumn("target", F.least(limit, F.lit(float(level)) * F.col("weight"))), n or 0, largest or 0


def _chance(seed: int, level: int, *keys: str) -> str:
    """SQL for a number in [0, 1) that depends only on the keys."""
    return f"(shiftrightunsigned(xxhash64({seed}L, {level}, {', '.join(keys)}), 11) / 9007199254740992D)"


def _trade(seed: int, level: int) -> str:
    """SQL that folds the sorted array ``members`` into the settled ones and the one that stays open.

    The open document has mass a and probability p, the next one b and q.  Moving up words d1 = min(a(1-p), bq)
    from the second to the first, or d2 = min(ap, b(1-q)) the other way, keeps ap + bq; taking the first with
    probability d2 / (d1 + d2) keeps both expectations.
    """
    open_, next_ = "state.open", "m"
    d1 = f"least({open_}.size * (1 - {open_}.p), {next_}.size * {next_}.p)"
    d2 = f"least({open_}.size * {open_}.p, {next_}.size * (1 - {next_}.p))"
    row = "named_struct('size', {0}.size, 'doc', {0}.doc, 'm', {0}.m, 'base', {0}.base, 'p', {1})"
    snap = "(case when {0} < 1e-9D then 0D when {0} > 1 - 1e-9D then 1D else {0} end)"
    up = _chance(seed, level, "state.open.doc", "m.doc", "state.open.size", "m.size") + f" * ({d1} + {d2}) < {d2}"
    p = snap.format(f"if({up}, {open_}.p + {d1} / {open_}.size, {open_}.p - {d2} / {open_}.size)")
    q = snap.format(f"if({up}, {next_}.p - {d1} / {next_}.size, {next_}.p + {d2} / {next_}.size)")
    a, b = row.format(open_, "t.p"), row.format(next_, "t.q")
    traded = f"transform(array(named_struct('p', {p}, 'q', {q})), t -> if(t.p in (0D, 1D), named_struct('done', {a}, 'open', {b}), named_struct('done', {b}, 'open', {a})))[0]"
    step = f"if({open_}.p in (0D, 1D), named_struct('done', {open_}, 'open', {next_}), {traded})"
    return f"""aggregate(slice(members, 2, size(members)), named_struct('done', slice(members, 1, 0), 'open', members[0]),
        (state, m) -> transform(array({step}), s -> named_struct('done', array_append(state.done, s.done), 'open', s.open))[0])"""


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies and taken (words).

    Needs the columns doc_id, text and source; others are ignored.  Null text and text without words have size 0:
    such documents trade no words, get their copies by an independent draw and take 0 words.  Null sources form one
    source, ranked last.  Rows that agree in doc_id, source and size are one unit whose copies are dealt out as
    evenly as can be, so repeated rows stay within ``most`` copies each.  An empty table gives an empty result.
    """
    sizes = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    sources, n, largest = source_targets(sizes, weights, share, most)
    sources = F.broadcast(sources) if n <= BROADCAST_SOURCES else sources
    units = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")).alias("u").join(sources.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source")))
    p = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("m")
    units = units.select(F.col("u.doc_id").alias("doc"), "u.source", "u.size", "m", "source_size", "target", F.floor(p + 1e-9).alias("base"), F.greatest(F.lit(0.0), p - F.floor(p + 1e-9)).alias("p"), F.ceil(F.col("rows") / FAN_IN).alias("buckets"))
    empty = units.where("size = 0").withColumn("p", F.expr(f"if({_chance(seed, -1, 'doc')} < p, 1D, 0D)"))
    facts = ["source", "source_size", "target"]
    row = F.struct("size", "doc", "m", "base", "p")
    open_ = units.where("size > 0").withColumn("bucket", F.expr(f"pmod(xxhash64({seed}L, doc, size), buckets)")).select(*facts, "bucket", row.alias("row"))
    settled = [empty.select(*facts, row.alias("row"))]
    level, buckets = 0, max(1, -(-largest // FAN_IN))
    while True:
        tree = open_.groupBy(*facts, "bucket").agg(F.reverse(F.array_sort(F.collect_list("row"))).alias("members")).withColumn("after", F.expr(_trade(seed, level)))
        tree = materialise(tree.select(*facts, "bucket", "after"), f"trades{level}")
        settled.append(tree.select(*facts, F.explode("after.done").alias("row")))
        if buckets == 1:
            break
        level, buckets = level + 1, -(-buckets // FAN_IN)
        open_ = tree.select(*facts, F.floor(F.col("bucket") / FAN_IN).alias("bucket"), F.col("after.open").alias("row"))
    last = F.expr(f"named_struct('size', after.open.size, 'doc', after.open.doc, 'm', after.open.m, 'base', after.open.base, 'p', if(after.open.p >= 0.5D, 1D, 0D))")
    settled.append(tree.select(*facts, last.alias("row")))
    every = reduce(DataFrame.unionByName, settled).withColumn("total", F.col("row.base") + F.col("row.p").cast("long"))
    every = every.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("row.m"))))
    copies = F.expr("total div row.m + if(k <= total % row.m, 1, 0)")
    return every.select(F.col("row.doc").alias("doc_id"), "source", F.col("row.size").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("row.size")).alias("taken"))


def mixed_corpus(docs: DataFrame, **how) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with the columns they came with.

    Documents match their copies by doc_id, source and word count (null-safe); among rows that agree in all three
    the extra copies go to the first of the distinct texts.  No copies, no row.
    """
    plan = mix_sources(docs, **how).groupBy("doc_id", "source", "size").agg(F.count("*").alias("m"), F.sum("copies").alias("total"))
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc")).withColumn("size", word_count(F.col("doc.text")))
    same = F.col("doc.doc_id").eqNullSafe(F.col("plan.doc_id")) & F.col("doc.source").eqNullSafe(F.col("plan.source")) & (F.col("d.size") == F.col("plan.size"))
    met = keyed.alias("d").join(plan.where("total > 0").alias("plan"), same).select("doc", "m", "total", F.col("plan.size").alias("size"))
    lone = met.where("m = 1").withColumn("copies", F.col("total"))
    order = "row_number() over (partition by doc.doc_id, doc.source, size order by doc.text)"
    many = met.where("m > 1").withColumn("k", F.expr(order)).withColumn("copies", F.expr("total div m + if(k <= total % m, 1, 0)")).drop("k")
    return lone.unionByName(many).where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select("doc.*")
