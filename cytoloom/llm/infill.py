"""Fill-in-middle transformation by markers injected into the text.

A delimiter is escaped in the text and appended after each unit by ``regexp_replace``; counting it gives the number of
units, and ``substring_index`` cuts the text after any unit.  The parts lose their delimiters, are unescaped and put
together behind the sentinels.  All of it is column expressions, so the texts never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The sentinels of the output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What is appended after each unit, and what stands before an escaped character; texts may hold both.
MARK, ESCAPE = "\u0001", "\u0002"
UNIT = f"(?s){ESCAPE}?."


def escape(text: Column) -> Column:
    """The text without MARK; ESCAPE stands before nothing but the two letters that stand for itself and for MARK."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}e")), F.lit(MARK), F.lit(f"{ESCAPE}m"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(f"{ESCAPE}m"), F.lit(MARK)), F.lit(f"{ESCAPE}e"), F.lit(ESCAPE))


def _part(marked: Column) -> Column:
    return unescape(F.replace(marked, F.lit(MARK), F.lit("")))


def _ranked(marked: str, count: str) -> Column:
    return F.expr(f"substring_index({marked}, '{MARK}', cast({count} as int))")


def place_hashes(doc_id: Column, salt: str = "1") -> Column:
    """Four unsigned numbers of 32 bits from the id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substr(digest, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long") for i in range(4)])


def infill(docs: DataFrame, rate: int = 90, spm: int = 20, salt: str = "1") -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars and output for every row of ``docs``.

    Units are code points.  ``rate`` of 100 texts are cut into prefix, middle and suffix at two places drawn by the id's
    hash; ``spm`` of 100 of these put the suffix first.  Null texts count as empty; texts that are empty or spell a
    sentinel stay ``plain``, with null lengths.  Repeated ids draw the same places, repeated rows give equal rows, a null
    id is an empty one, long texts are cut whole, and other columns are ignored.
    """
    h = F.col("h")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), place_hashes(F.col("doc_id"), salt).alias("h"))
    rows = rows.withColumn("escaped", escape(F.col("text")))
    rows = rows.withColumn("marked", F.regexp_replace("escaped", F.lit(UNIT), F.lit(f"$0{MARK}")))
    rows = rows.withColumn("n", (F.length("marked") - F.length("escaped")).cast("long"))
    spelled = F.lit(False)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        spelled = spelled | F.contains("text", F.lit(sentinel))
    plain = (F.col("n") == 0) | spelled | (h[2] % 100 >= rate)
    one, other = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    rows = rows.select("doc_id", "text", "marked", "n", F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm").alias("form"), F.least(one, other).alias("a"), F.greatest(one, other).alias("b"))
    # The last of the marks stands after the last unit, so the suffix follows the (n - b + 1)th from the end.
    rows = rows.withColumn("head", _ranked("marked", "b"))
    prefix, suffix, middle = _part(_ranked("marked", "a")), _part(_ranked("marked", "b - n - 1")), _part(_ranked("head", "a - b"))
    rows = rows.withColumn("parts", F.when(F.col("form") != "plain", F.array(prefix, suffix, middle)))
    p, s, m = F.concat(F.lit(PREFIX), F.col("parts")[0]), F.concat(F.lit(SUFFIX), F.col("parts")[1]), F.concat(F.lit(MIDDLE), F.col("parts")[2])
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", F.concat(s, p, m)).otherwise(F.concat(p, s, m))
    cut = F.col("form") != "plain"
    return rows.select("doc_id", "text", "n", "form", F.when(cut, F.col("a")).alias("prefix_chars"), F.when(cut, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of.  No part spells a sentinel, nor can one begin in a part and end outside of it."""
    after = lambda text, sentinel: F.substring_index(text, sentinel, -1)
    before = lambda text, sentinel: F.substring_index(text, sentinel, 1)
    psm = F.concat(before(after(output, PREFIX), SUFFIX), after(output, MIDDLE), before(after(output, SUFFIX), MIDDLE))
    spm = F.concat(before(after(output, PREFIX), MIDDLE), after(output, MIDDLE), before(after(output, SUFFIX), PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def infill_report(docs: DataFrame) -> DataFrame:
    """What ``infill`` makes of every document, with digests of its outputs and of the texts restored from them."""
    made = infill(docs)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


INFILL_SQL = """
    WITH t AS (
        SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
    ), h AS (
        SELECT *, CAST('0x' || substr(x, 1, 8) AS BIGINT) % (n + 1) AS one, CAST('0x' || substr(x, 9, 8) AS BIGINT) % (n + 1) AS other,
            CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(x, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
                WHEN CAST('0x' || substr(x, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t
    ), c AS (
        SELECT *, least(one, other) AS a, greatest(one, other) AS b FROM h
    ), p AS (
        SELECT *, '<P>' || substr(text, 1, a) AS pre, '<S>' || substr(text, b + 1) AS suf, '<M>' || substr(text, a + 1, b - a) AS mid FROM c
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN pre || suf || mid ELSE suf || pre || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
