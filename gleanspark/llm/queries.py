"""The queries opN_<name> of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm.bpe import VOCABULARY, encode
from gleanspark.llm.crf_quality import score_quality
from gleanspark.llm.gif import page_frames
from gleanspark.llm.jaccard_join import jaccard_join
from gleanspark.llm.language_id import identify
from gleanspark.llm.metric_join import range_join
from gleanspark.llm.packing import pack
from gleanspark.llm.secret_scan import find_secrets
from gleanspark.llm.suffix_dedup import repeated_passages
from gleanspark.llm.url_filter import filter_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), capacity=2048)


def op2_gif_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no media, so each page's whole text is made a GIF, a pixel a byte, which is decoded into frames.

    Pixels are given as the SHA-256 of a frame's RGBA bytes; ``decode_gifs`` returns these bytes themselves.
    """
    return page_frames(table(spark, sf_dir, "pages")).withColumn("pixels", F.sha2("pixels", 256))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), least=50)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"), threshold=0.5)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine similarity of unit vectors of about 0.9 or more."""
    return range_join(table(spark, sf_dir, "embeddings"), radius=0.45)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), path=VOCABULARY)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), sample=4000)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5, sample=4000)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), threshold=0.5)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), t=0.7, n=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_gif_frames, op3_suffix_array_dedup, op4_language_id, op5_quality_classifier, op6_ngram_jaccard_join, op7_url_filter, op8_secret_scan, op9_embedding_near_dedup, op10_byte_bpe,
    )
}

_WORDS = r"regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_gif_frames": """
        WITH p AS (SELECT page_id, hex(encode(html)) AS h, octet_length(encode(html)) AS n FROM pages WHERE html <> ''),
        f AS (SELECT page_id, h, n, unnest(range(0, (n + 4095) // 4096)) AS k FROM p),
        r AS (SELECT *, least(4096, n - 4096 * k) AS m, least(64, (n + 63) // 64) AS rows FROM f),
        b AS (SELECT page_id, k, i, ('0x' || substr(h, 2 * (4096 * k + i) + 1, 2))::INT AS v FROM (SELECT *, unnest(range(0, m)) AS i FROM r)),
        c AS (SELECT page_id, k, CASE WHEN v = 0 THEN '00000000' ELSE printf('%02X%02X%02XFF', v, 7 * v % 256, 13 * v % 256) END AS rgba, i,
                     CASE WHEN v > 0 THEN (v // 64) * 16 + (7 * v % 256 // 64) * 4 + 13 * v % 256 // 64 END AS bin FROM b),
        g AS (SELECT page_id, k, string_agg(rgba, '' ORDER BY i) AS x, list(bin) FILTER (WHERE bin IS NOT NULL) AS bins FROM c GROUP BY page_id, k)
        SELECT r.page_id AS media_id, r.k::INT AS frame, coalesce(list_sum(list_transform(range(0, r.k), lambda j: 10 * (2 + j % 5))), 0)::BIGINT AS start_ms, (10 * (2 + r.k % 5))::INT AS delay_ms, 64 AS width, r.rows::INT AS height,
               sha256(unhex(x || repeat('00000000', (64 * r.rows - r.m)::INT))) AS pixels, list_transform(range(0, 64), lambda b: len(list_filter(bins, lambda y: y = b))::INT) AS histogram, NULL::VARCHAR AS error
        FROM r JOIN g ON r.page_id = g.page_id AND r.k = g.k
        UNION ALL SELECT page_id, 0, NULL, NULL, NULL, NULL, NULL, NULL, 'no content' FROM pages WHERE coalesce(html, '') = ''""",
    "op6_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
        g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)) AS grams FROM w WHERE len(w) > 0),
        s AS (SELECT min(doc_id) AS node, count(DISTINCT doc_id) AS weight, grams, len(grams) AS n FROM g GROUP BY grams),
        u AS (SELECT node, n, unnest(grams) AS gram FROM s),
        p AS (SELECT a.node AS a, b.node AS b FROM u a JOIN u b ON a.gram = b.gram AND a.node <> b.node
              GROUP BY a.node, b.node, a.n, b.n HAVING count(*) >= 0.7 * (a.n + b.n - count(*)) - 1e-6),
        r AS (SELECT node AS x, node AS y FROM s UNION SELECT r.x, p.b FROM r JOIN p ON r.y = p.a),
        c AS (SELECT x AS node, min(y) AS class_id FROM r GROUP BY x),
        l AS (SELECT p.a AS node, sum(s.weight) AS links FROM p JOIN s ON s.node = p.b GROUP BY p.a)
        SELECT DISTINCT g.doc_id, c.class_id, (s.weight - 1 + coalesce(l.links, 0))::BIGINT AS links
        FROM g JOIN s ON s.grams = g.grams JOIN c ON c.node = s.node LEFT JOIN l ON l.node = s.node
        UNION ALL SELECT DISTINCT doc_id, NULL::BIGINT, 0::BIGINT FROM documents WHERE doc_id IS NOT NULL AND NOT regexp_matches(coalesce(text, ''), '[^ \t\n\x0B\f\r]')""",
    "op3_suffix_array_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        p AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + 50], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS s FROM w WHERE len(w) >= 50)),
        f AS (SELECT doc_id, s, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM p),
        m AS (SELECT doc_id, s, false AS again FROM f WHERE n > 1 UNION ALL SELECT doc_id, s, true FROM f WHERE r > 1),
        c AS (SELECT *, s - lag(s) OVER (PARTITION BY doc_id, again ORDER BY s) > 50 AS cut FROM m),
        i AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, again ORDER BY s) AS island FROM c)
        SELECT doc_id, min(s)::BIGINT AS begin, (max(s) + 50)::BIGINT AS "end", again FROM i GROUP BY doc_id, again, island""",
    "op9_embedding_near_dedup": """
        WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND len(a.embedding) = len(b.embedding)
              WHERE sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2))) <= 0.45),
        r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, p.b FROM r JOIN p ON r.y = p.a),
        l AS (SELECT a, count(*) AS links FROM p GROUP BY a)
        SELECT x AS vec_id, min(y) AS class_id, coalesce(max(l.links), 0)::BIGINT AS links FROM r LEFT JOIN l ON l.a = r.x GROUP BY x""",
}
