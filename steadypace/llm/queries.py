"""Thin registered queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadypace.llm import quality, toxicity
from steadypace.llm.bpe_trie import digests
from steadypace.llm.decontaminate import contamination, report
from steadypace.llm.fingerprints import fingerprints
from steadypace.llm.hard_negatives import hard_negatives, shifted_labels
from steadypace.llm.licenses import KNOWN, known_licenses, scan_licenses
from steadypace.llm.near_dedup import near_duplicates
from steadypace.llm.packing import piece_digests
from steadypace.llm.pages import main_text
from steadypace.llm.ranked_search import ranked_search
from steadypace.llm.sharding import kd_shards
from steadypace.llm.urls import judge_urls

# The rules the query asks for.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), tokenizer())


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dimensions = {"length": F.log1p(F.length("text")), "source_key": F.crc32(F.col("source").cast("binary")),
                  "lang_key": F.crc32(F.col("lang").cast("binary"))}
    return kd_shards(docs, dimensions, shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), known_licenses(spark))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(shifted_labels(table(spark, sf_dir, "embeddings")))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), tokenizer())


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_near_dedup, op3_packing, op4_decontamination, op5_main_text,
    op6_fingerprints, op7_sharding, op8_licenses, op9_toxicity, op10_urls,
    op11_hard_negatives, op12_bpe, op13_ranked_search,
)}
# What is defined exactly enough for plain SQL.
ORACLE: dict[str, str] = {"op10_urls": """
    WITH rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                   ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0
                             THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id,
                     translate(regexp_extract(rest, '^([^/?#]*)', 1),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    judged AS (SELECT *, (SELECT arg_max({'rule': h || p, 'verdict': v}, length(h || p)) FROM rules
                          WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best
               FROM parts)
    SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged""",
    "op2_near_dedup": r"""
    WITH RECURSIVE lower_case AS (
        SELECT row_number() OVER () AS r, doc_id,
               regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x20\x09-\x0D]+') AS w
        FROM documents),
    words AS (SELECT r, doc_id, coalesce(w, []) AS w FROM lower_case),
    sets AS (
        SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS s
        FROM words),
    every AS (SELECT r, len(s) AS size, unnest(s) AS shingle FROM sets WHERE doc_id IS NOT NULL),
    numbered AS (SELECT r, size, dense_rank() OVER (ORDER BY shingle) AS shingle FROM every),
    shared AS (
        SELECT a.r AS a, b.r AS b, a.size AS a_size, b.size AS b_size, count(*) AS n
        FROM numbered a JOIN numbered b ON a.shingle = b.shingle AND a.r < b.r
             AND 100 * a.size >= 85 * b.size AND 100 * b.size >= 85 * a.size
        GROUP BY ALL),
    similar_rows AS (SELECT a, b FROM shared WHERE 100 * n >= 85 * (a_size + b_size - n)),
    links AS (SELECT a, b FROM similar_rows UNION ALL SELECT b, a FROM similar_rows),
    reached AS (
        SELECT r, r AS t FROM sets
        UNION
        SELECT reached.r, links.b FROM reached JOIN links ON reached.t = links.a)
    SELECT x.doc_id, CAST(len(x.s) AS BIGINT) AS n_shingles, c.component_id,
           x.doc_id IS NOT DISTINCT FROM c.component_id AS kept
    FROM sets x JOIN (SELECT reached.r, min(y.doc_id) AS component_id FROM reached JOIN sets y ON y.r = reached.t
                      GROUP BY reached.r) c ON c.r = x.r""",
    "op4_decontamination": r"""
    WITH texts AS (
        SELECT row_number() OVER () AS r, doc_id,
               coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
        FROM documents),
    items AS (
        SELECT CAST(item_id AS VARCHAR) AS item, len(w) AS n, least(len(w), 10) AS size, w FROM (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                         'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(w) > 0),
    patterns AS (
        SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS pattern
        FROM (SELECT *, unnest(range(1, n - size + 2)) AS i FROM items)),
    windows AS (
        SELECT r, size, i, array_to_string(w[i : i + size - 1], ' ') AS pattern
        FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i
              FROM texts, (SELECT DISTINCT size FROM patterns) WHERE len(w) >= size)),
    found AS (SELECT r, i, w.size, item FROM windows w JOIN patterns p ON w.size = p.size AND w.pattern = p.pattern),
    hit AS (
        SELECT r, count(DISTINCT place) AS n_hit
        FROM (SELECT r, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT r, i, size FROM found)) GROUP BY r),
    named AS (
        SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
        FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM texts LEFT JOIN hit ON hit.r = texts.r LEFT JOIN named ON named.r = texts.r""",
    "op11_hard_negatives": """
    WITH rows AS (
        SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same,
               CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v, true), lambda z: z[1] * z[2])), 0) AS BIGINT)
                   AS score
        FROM rows a JOIN rows b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
    positives AS (
        SELECT * FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, r) <= 5)
    SELECT p.anchor_id, p.vec_id AS positive_id,
           CAST(row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.vec_id NULLS LAST, n.r) AS INTEGER)
               AS rank,
           n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
         AND 80 * p.score <= 100 * n.score AND n.score <= p.score
    QUALIFY rank <= 5""",
    "op13_ranked_search": r"""
    WITH words AS (
        SELECT row_number() OVER () AS d, doc_id,
               regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents),
    kept AS (SELECT d, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM words WHERE len(terms) > 0),
    totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM kept),
    tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM kept) GROUP BY ALL),
    weights AS (
        SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
        FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
    asked AS (
        SELECT i, item_id, term, count(*) AS repeats
        FROM (SELECT i, item_id, unnest(terms) AS term FROM (
            SELECT row_number() OVER () AS i, item_id,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM benchmark)) GROUP BY ALL),
    scored AS (
        SELECT i, any_value(item_id) AS item_id, d, any_value(doc_id) AS doc_id,
               CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))
                    AS BIGINT) AS score
        FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN kept USING (d), totals
        GROUP BY i, d)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, d) AS INTEGER) AS rank,
           doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 20""",
}
