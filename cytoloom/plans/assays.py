"""Queries over reads that carry barcodes: the read view with tags of several pools in front of its second mates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoloom.operators import barcodes, chemistry
from cytoloom.operators.chemistry import Chemistry, Pool
from cytoloom.plans.views import HEX, UMI, sql_view, view

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


POOLS = (1, 2, 3, 4)


def _letters(x: str, cast: str, size: int = 8) -> str:
    return f"translate(substr(md5(cast({x} as {cast})), 1, {size}), '{HEX}', '{UMI}')"


def _tag(pool: int, cast: str, div: str) -> str:
    """The barcode of a read in a pool; one base of every fifth is wrong in pool 2, and of every seventh in pool 3."""
    tag = _letters(f"'NATION_' || ((ordinal * {pool} + {div}) % 25) || '_{pool}'", cast)
    turned = {2: (5, f"translate(substr({tag}, 1, 1), 'ACGT', 'CGTN') || substr({tag}, 2, 7)"), 3: (7, f"substr({tag}, 1, 7) || translate(substr({tag}, 8, 1), 'ACGT', 'TACG')")}
    return f"case when ordinal % {turned[pool][0]} = 0 then {turned[pool][1]} else {tag} end" if pool in turned else tag


def _tagged(cast: str, div: str) -> str:
    parts = " || 'GG' || ".join(f"({_tag(p, cast, div)})" for p in POOLS)
    return f"umi || repeat('T', cast(ordinal % 3 as int)) || {parts} || 'TTTT' || r2"


def _two_tags(cast: str, div: str) -> str:
    return f"({_tag(2, cast, div)}) || ({_tag(3, cast, div)}) || r2"


SPARK, DUCK = ("string", "ordinal div 10000"), ("varchar", "ordinal // 10000")


def pooled_whitelist(spark, sf_dir):
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey as idx", "n_name", "explode(array(1, 2, 3, 4)) as pool")
    return nations.selectExpr("pool", "idx", "concat('P', pool, 'W', idx) as name", f"{_letters('''n_name || '_' || pool''', 'string')} as seq")


def _reads(spark, sf_dir, made: str):
    return view(spark, sf_dir, "reads").drop("cell_id").withColumn("r2", F.expr(made)).withColumn("q2", F.expr("repeat('F', length(r2))"))


def _sql(made: str) -> str:
    whitelist = f"w as (select pool, n_nationkey as idx, 'P' || pool || 'W' || n_nationkey as name, {_letters('''n_name || '_' || pool''', 'varchar')} as seq from nation, (values (1), (2), (3), (4)) p(pool))"
    return f"with {sql_view('reads')}, {whitelist}, x as (select ordinal, umi, r1, q1, {made} as r2 from reads)"


def _assigned(made: str, pools: list[Pool], total: int) -> str:
    """SQL for the reads that are accepted: ordinal, cell_id, distance and where the last barcode ends."""
    places = ", ".join(f"({p.pool}, {i}, {at})" for p in pools for i, at in enumerate(p.places))
    return f"""{_sql(made)}, places(pool, place, pos) as (values {places}),
        tags as (select ordinal, pool, place, pos, substr(r2, pos + 1, 8) as tag from x, places),
        near as (select pool, tag, idx, name, hamming(tag, seq) as distance from (select distinct pool, tag from tags where length(tag) = 8) join w using (pool) where hamming(tag, seq) <= 1 qualify row_number() over (partition by pool, tag order by distance, idx) = 1),
        hits as (select ordinal, pool, name, distance, pos + 8 as stop from tags join near using (pool, tag) qualify row_number() over (partition by ordinal, pool order by distance, place, idx) = 1),
        cells as (select ordinal, cast(sum(distance) as int) as distance, string_agg(name, '_' order by pool) as cell_id, max(stop) as stop from hits group by ordinal having count(*) = {len(pools)} and sum(distance) <= {total})"""


FOUR = Chemistry("four", tuple(Pool(p, (10 * p - 2, 10 * p - 1, 10 * p)) for p in POOLS), "r2", (0, 8), 1, 1, True, True)
_REST = "regexp_replace(substr(r2, stop + 1), '^T+', '')"


@query(f"""{_assigned(_tagged(*DUCK), list(FOUR.pools), 1)} select ordinal, cell_id, case when cell_id is not null then substr(r2, 1, 8) end as umi, distance, cell_id is not null as accepted, r1,
    case when cell_id is null then r2 else {_REST} end as r2, case when cell_id is null then length(r2) else length({_REST}) end as bases from x left join cells using (ordinal)""")
def four_pools(spark, sf_dir):
    found = chemistry.assign_cells(_reads(spark, sf_dir, _tagged(*SPARK)), pooled_whitelist(spark, sf_dir), FOUR)
    return found.select("ordinal", "cell_id", "umi", "distance", "accepted", "r1", "r2", F.length("q2").cast("long").alias("bases"))


@query(f"""{_sql(_tagged(*DUCK))}, h as (select pool, place, count(*) as hits from (select unnest(range(0, length(r2) - 7)) as place, r2 from x) join w on substr(r2, place + 1, 8) = seq group by all)
    select pool, cast(place as int) as place, cast(row_number() over (partition by pool order by hits desc, place) - 1 as int) as rank from h qualify hits >= 0.05 * sum(hits) over (partition by pool)""")
def barcode_places(spark, sf_dir):
    histogram = chemistry.place_histogram(_reads(spark, sf_dir, _tagged(*SPARK)), pooled_whitelist(spark, sf_dir))
    return chemistry.find_places(histogram)


_TWO = [(2, 0), (3, 8)]


@query(f"""{_assigned(_two_tags(*DUCK), [Pool(p, (at,)) for p, at in _TWO], 1)} select ordinal, 'lib_' || cell_id as cell_id, umi, r1, substr(r2, 17) as r2 from x join cells using (ordinal)""")
def debarcode(spark, sf_dir):
    found = barcodes.debarcode(_reads(spark, sf_dir, _two_tags(*SPARK)), pooled_whitelist(spark, sf_dir), _TWO, library="lib")
    return found.select("ordinal", "cell_id", "umi", "r1", "r2")


def _long_tag(cast: str) -> str:
    code = _letters("o_custkey", cast, 16)
    return f"case when o_orderkey % 7 = 0 then 'N' || substr({code}, 2, 6) || 'N' || substr({code}, 9, 8) when o_orderkey % 3 = 0 then substr({code}, 1, 11) || 'N' || substr({code}, 13, 4) else {code} end"


@query(f"""with w as (select cast(c_custkey as int) as idx, c_name as name, {_letters("c_custkey", "varchar", 16)} as seq from customer), t as (select o_orderkey as ordinal, {_long_tag("varchar")} as tag from orders),
    halves as (select idx, name, seq, 0 as side, substr(seq, 1, 8) as part from w union all select idx, name, seq, 1, substr(seq, 9) from w), sides as (select distinct tag, 0 as side, substr(tag, 1, 8) as part from t union select distinct tag, 1, substr(tag, 9) from t),
    b as (select tag, idx, name, cast(hamming(tag, seq) as int) as distance from (select distinct tag, idx, name, seq from sides join halves using (side, part)) where hamming(tag, seq) <= 1 qualify row_number() over (partition by tag order by distance, idx) = 1)
    select ordinal, tag, name, idx, distance from t left join b using (tag)""")
def barcode_halves(spark, sf_dir):
    # One barcode of 16 bases for each customer; a third of the tags have one wrong base, a seventh one in either half.
    whitelist = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("cast(c_custkey as int) as idx", "c_name as name", f"{_letters('c_custkey', 'string', 16)} as seq")
    tags = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey as ordinal", f"{_long_tag('string')} as tag")
    return barcodes.nearest_long_barcode(tags, whitelist)


_MOST = 2


def _edited(cast: str) -> str:
    """A barcode inside of a read: every third lacks a base, every fifth has a wrong one."""
    code = _letters("'NATION_' || (ordinal % 25)", cast)
    code = f"case when ordinal % 3 = 0 then substr({code}, 1, 3) || substr({code}, 5) else {code} end"
    code = f"case when ordinal % 5 = 0 then 'N' || substr({code}, 2) else {code} end"
    return f"substr(r1, 1, 8) || ({code}) || substr(r1, 9, 6)"


@query(f"""with {sql_view("reads")}, {sql_view("whitelist")}, x as (select ordinal, {_edited("varchar")} as seq from reads), windows as (select seq, i, n, substr(seq, i, n) as part from (select distinct seq from x), range(1, 23) a(i), range({8 - _MOST}, {9 + _MOST}) b(n) where i + n - 1 <= length(seq)),
    d as (select windows.seq, idx, name, cast(levenshtein(part, whitelist.seq) as int) as distance, cast(i + n - 1 as int) as "end" from windows, whitelist where levenshtein(part, whitelist.seq) <= {_MOST}),
    b as (select * from d qualify row_number() over (partition by seq order by distance, idx, "end") = 1)
    select ordinal, name, idx, distance, "end" from x left join b using (seq)""")
def barcode_edit_places(spark, sf_dir):
    reads = view(spark, sf_dir, "reads").selectExpr("ordinal", f"{_edited('string')} as seq")
    return chemistry.find_barcodes(reads, view(spark, sf_dir, "whitelist"), most=_MOST).drop("seq")
