"""The driver's tables seen as sequencing data, once as DataFrames and once as SQL with the same rows.

Each view is a list of columns with their Spark and, where it differs, their DuckDB expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTANGTACGTACGTAC"
HEX, UMI = "0123456789abcdef", "ACGTACGTACGTACGT"
PIECE = 300


def _nuc(x: str, flag: str = "") -> str:
    return f"translate(regexp_replace(lower({x}), '[^a-z]', 'n'{flag}), '{LETTERS}', '{BASES}')"


def _both(text: str) -> tuple[str, str]:
    return text, text


def _umi(x: str) -> tuple[str, str]:
    return f"translate(substr(md5(cast({x} as string)), 1, 8), '{HEX}', '{UMI}')", f"translate(substr(md5(cast({x} as varchar)), 1, 8), '{HEX}', '{UMI}')"


def _piece(at: int) -> tuple[str, str]:
    s, d = f"substr(part, {at + 1}, 150)", f"substr(text, piece * {PIECE} + {at + 1}, 150)"
    return _nuc(s), _nuc(d, ", 'g'")


#: Whole texts in read pairs of 2 x 150 letters.
READS = {
    "cell_id": _both("lang || '_' || source"),
    "r1": _piece(0),
    "r2": _piece(150),
    "umi": _umi("doc_id"),
    "ordinal": _both("doc_id * 10000 + piece"),
}
ORDINAL = "(l_orderkey * 10 + l_linenumber) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000"
DAYS = ("datediff(l_shipdate, date'1992-01-01')", "date_diff('day', timestamp '1992-01-01', l_shipdate)")
M = "cast(round(l_quantity) as int)"
POS = tuple(f"cast({d} * 10 + l_linenumber as bigint)" for d in DAYS)
ALIGNMENTS = {
    "file_id": _both("cast('0' as varchar(1))"),
    "ordinal": _both(ORDINAL),
    "cell_id": _both("'C' || (l_orderkey % 97)"),
    "umi": _umi("l_orderkey"),
    "qname": tuple(f"'C' || (l_orderkey % 97) || ':' || {u} || ':' || l_orderkey" for u in _umi("l_orderkey")),
    "flag": _both("cast(1 + case when l_returnflag = 'R' and l_linenumber <= 3 then 4 else 0 end + case when l_linestatus = 'F' then 16 else 0 end + case when l_linenumber % 2 = 1 then 64 else 128 end + case when l_linenumber = 7 then 256 else 0 end as int)"),
    "chrom": _both("'chr' || (l_partkey % 50)"),
    "pos": POS,
    "m_len": _both(M),
    "spliced": _both("l_linenumber % 3 = 0"),
    "end_pos": tuple(f"{p} + {M} + case when l_linenumber % 3 = 0 then 30 else 0 end" for p in POS),
    "mapq": _both("case when l_linenumber = 6 then null else cast(round(l_discount * 100) as int) end"),
    "l_seq": _both("50"),
}
FEATURES = {
    "gene_id": _both("'G' || p_partkey"),
    "chrom": _both("'chr' || (p_partkey % 50)"),
    "start": _both("cast(p_size * 700 as bigint)"),
    "end": _both("cast(p_size * 700 + 1 + cast(round(p_retailprice) as int) % 500 as bigint)"),
}
CONTIGS = {
    "cell_id": _both("source"),
    "seq": (_nuc("text"), _nuc("text", ", 'g'")),
}
WHITELIST = {
    "pool": _both("1"),
    "idx": _both("n_nationkey"),
    "name": _both("'W' || n_nationkey"),
    "seq": _umi("n_name"),
}


def _code(key: str, cast: str) -> str:
    return f"translate(substr(md5(cast('NATION_' || ({key} % 25) as {cast})), 1, 8), '{HEX}', '{UMI}')"


def _mutated(cast: str) -> str:
    code = _code("o_custkey", cast)
    one = f"translate(substr({code}, 1, 1), 'ACGT', 'CGTN') || substr({code}, 2, 7)"
    two = f"substr({code}, 1, 6) || translate(substr({code}, 7, 2), 'ACGT', 'TACG')"
    return f"case when o_orderkey % 7 = 0 then {two} when o_orderkey % 3 = 0 then {one} else {code} end"


#: Orders as reads that carry a barcode, some with one or two wrong bases.
TAGS = {
    "ordinal": _both("o_orderkey"),
    "tag": (_mutated("string"), _mutated("varchar")),
}

#: A text is cut in one pass over it; ``substr`` of each piece would walk from its start every time.
_PIECES = {"spark": f"posexplode(case when text is null or text = '' then array(text) else regexp_extract_all(text, '(?s).{{1,{PIECE}}}', 0) end) as (piece, part)", "duck": "unnest(range(0, (greatest(length(text), 1) - 1) // 300 + 1))"}
SOURCES = {"reads": ("documents", READS), "alignments": ("lineitem", ALIGNMENTS), "features": ("part", FEATURES), "contigs": ("documents", CONTIGS), "whitelist": ("nation", WHITELIST), "tags": ("orders", TAGS)}


def spread(rows: DataFrame) -> DataFrame:
    """A scan dealt over the session's cores where it comes in fewer tasks, as a file of one row group does.

    A task reads ``spark.sql.files.maxPartitionBytes`` at most, so what is dealt anew is bounded by the cores; larger
    tables are left as they are scanned.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def pieces(docs: DataFrame) -> DataFrame:
    """The columns of the documents but the text, with ``part``, its ``piece``-th PIECE letters; a text without letters has one."""
    return docs.selectExpr(*[c for c in docs.columns if c != "text"], _PIECES["spark"])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = SOURCES[name]
    needed = {"reads": ["doc_id", "text", "lang", "source"], "contigs": ["text", "source"]}.get(name)
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    rows = spread(rows.select(needed) if needed else rows) if name in ("reads", "contigs", "alignments") else rows
    if name == "reads":
        rows = pieces(rows)
    out = rows.selectExpr(*[f"{expr[0].replace('varchar(1)', 'string')} as `{c}`" for c, expr in columns.items()])
    if name == "reads":
        out = out.selectExpr("*", "translate(r1, 'ACGTN', 'FFFF#') as q1", "translate(r2, 'ACGTN', 'FFFF#') as q2")
    if name == "alignments":
        gap = "array(named_struct('op', 'N', 'len', 20), named_struct('op', 'M', 'len', 10))"
        head, tail = "array(named_struct('op', 'M', 'len', m_len))", "array(named_struct('op', 'S', 'len', greatest(0, 50 - m_len)))"
        out = out.selectExpr("*", f"concat({head}, if(spliced, {gap}, slice({gap}, 1, 0)), {tail}) as cigar").drop("m_len", "spliced")
    return out


def sql_view(name: str) -> str:
    table, columns = SOURCES[name]
    source = f"(select doc_id, text, lang, source, {_PIECES['duck']} as piece from documents)" if name == "reads" else table
    text = ", ".join(f'{expr[1]} as "{c}"' for c, expr in columns.items())
    if name == "reads":
        return f"{name} as (select *, translate(r1, 'ACGTN', 'FFFF#') as q1, translate(r2, 'ACGTN', 'FFFF#') as q2 from (select {text} from {source}))"
    return f"{name} as (select {text} from {source})"


def with_views(*names: str) -> str:
    return "with " + ", ".join(sql_view(n) for n in names)
