"""The registered queries of this subpackage, one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cytoloom.llm import infill, languages, licenses, media, mixing, ngram_join, packing, pii, quality, repeats, runs, vector_join, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(_table(spark, sf_dir, "documents"), words=4, similarity=(85, 100)).select("doc_id", "n_shingles", "component_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(licenses.document_files(_table(spark, sf_dir, "documents")), licenses.template_table(spark))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(_table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_table(_table(spark, sf_dir, "pages"))


def op11_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.predict_languages(_table(spark, sf_dir, "documents"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_report(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_ngram_jaccard_join, op3_license_scan, op4_best_fit_packing, op5_media_columns, op6_embedding_near_dedup, op7_quality, op8_repeated_substrings, op9_pii, op10_warc, op11_language_mixture, op12_infill, op13_periodic_runs)}

ORACLE_SQL = {
    "op3_license_scan": """
        WITH files AS (
            SELECT row_number() OVER () AS fid, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, concat_ws('/', source, lang) AS dir, string_split_regex(text, '\\r?\\n') AS ls FROM documents
        ), lines AS (
            SELECT fid, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM files
        ), marked AS (
            SELECT *, regexp_matches(line, '[A-Za-z0-9]') AS filled, regexp_matches(line, '^[ \\t]*(?://|/?\\*|#|--|;|%|<!--|(?i:rem|dnl)\\b)') AS comment FROM lines
        ), grouped AS (
            SELECT *, sum(CASE WHEN filled THEN 0 ELSE 1 END) OVER (PARTITION BY fid ORDER BY i) AS paragraph, i - row_number() OVER (PARTITION BY fid, comment ORDER BY i) AS run FROM marked
        ), terms AS (
            SELECT fid, i, paragraph, CASE WHEN comment THEN run END AS run, term, count(*) AS n FROM (SELECT *, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS term FROM grouped) GROUP BY ALL
        ), parts AS (
            SELECT fid, 'line' AS kind, i AS part, term, n FROM terms UNION ALL SELECT fid, 'pair', i, term, n FROM terms UNION ALL SELECT fid, 'pair', i - 1, term, n FROM terms
            UNION ALL SELECT fid, 'paragraph', paragraph, term, n FROM terms UNION ALL SELECT fid, 'comment', run, term, n FROM terms WHERE run IS NOT NULL
            UNION ALL SELECT fid, 'whole', 0, term, n FROM terms
        ), own AS (
            SELECT fid, kind, part, term, sum(n) AS tf FROM parts GROUP BY ALL
        ), templates(license, line) AS (VALUES
            TEMPLATE_ROWS
        ), given AS (
            SELECT id, license, term, count(*) AS tf FROM (SELECT row_number() OVER () AS id, license, regexp_extract_all(lower(line), '[a-z0-9]+') AS terms FROM templates) t, unnest(t.terms) u(term) GROUP BY ALL
        ), n AS (
            SELECT count(*) AS n FROM templates
        ), idf AS (
            SELECT term, ln((1.0 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf FROM given GROUP BY term
        ), t AS (
            SELECT id, license, term, (1 + ln(tf)) * idf / sqrt(sum(((1 + ln(tf)) * idf) ** 2) OVER (PARTITION BY id)) AS t FROM given JOIN idf USING (term)
        ), w AS (
            SELECT fid, kind, part, term, (1 + ln(tf)) * coalesce(idf, ln(1.0 + (SELECT n FROM n)) + 1) AS w FROM own LEFT JOIN idf USING (term)
        ), dots AS (
            SELECT fid, kind, part, id, license, sum(w * t) AS dot FROM w JOIN t USING (term) GROUP BY ALL
        ), rated AS (
            SELECT path, dir, kind, license, round(dot / norm, 6) AS score FROM dots JOIN (SELECT fid, kind, part, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL) USING (fid, kind, part)
            JOIN files USING (fid) WHERE round(dot / norm, 6) >= 0.5
        ), of_file AS (
            SELECT path, license AS own_license, score FROM rated QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1
        ), of_dir AS (
            SELECT dir AS from_dir, license AS dir_license FROM rated WHERE kind = 'whole' QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1
        ), place AS (
            SELECT DISTINCT path, dir FROM files
        ), nearest AS (
            SELECT dir, from_dir, dir_license FROM (SELECT DISTINCT dir FROM place) JOIN of_dir ON from_dir = '' OR dir = from_dir OR starts_with(dir, from_dir || '/')
            QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(from_dir) DESC) = 1
        )
        SELECT path, own_license, score, coalesce(own_license, dir_license) AS license, CASE WHEN own_license IS NULL THEN from_dir END AS inherited_from
        FROM place LEFT JOIN of_file USING (path) LEFT JOIN nearest USING (dir)
    """.replace("TEMPLATE_ROWS", ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.template_rows())),
    "op6_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        ), c AS (
            SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
        ), n AS (
            SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
        )
        SELECT c.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
        FROM c LEFT JOIN n USING (vec_id)
    """,
    "op12_infill": infill.INFILL_SQL,
    "op10_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
            CASE WHEN p.page_id > f.first AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN p.page_id > f.first AND payload_bytes >= 100 THEN f.first END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """,
}
