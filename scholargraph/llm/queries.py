"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholargraph.llm.packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"), _tokenizer(), 4096, 1)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholargraph.llm.pii import find

    return find(_read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholargraph.llm.quality import quality_rules

    return quality_rules(_read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholargraph.llm.lines import clean_lines

    return clean_lines(_read(spark, sf_dir, "documents"), min_sites=10, min_words=3).select("doc_id", "text", "n_lines", "n_removed")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholargraph.llm.toxicity import scored

    return scored(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholargraph.llm.decontamination import contaminated

    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), share=0.8, width=5)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholargraph.llm.tokens import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), _tokenizer(), 2048)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholargraph.llm.licenses import scan

    return scan(_read(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholargraph.llm.secrets import scan

    return scan(_read(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholargraph.llm.simhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), width=4, distance=4, seed=42)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholargraph.llm.ranking import search

    return search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), 20)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholargraph.llm.negatives import hard_negatives

    id = F.col("vec_id")
    return hard_negatives(_read(spark, sf_dir, "embeddings"), id % 50 == 0, positives=5, negatives=3, low=50, high=95, noisy=id % 7 == 0)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholargraph.llm.additive import scored

    return scored(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_personal_data,
        op3_quality_rules,
        op4_token_counts,
        op5_line_dedup,
        op6_toxicity,
        op7_license_scan,
        op8_secret_scan,
        op9_simhash,
        op10_decontamination,
        op11_ranked_search,
        op12_hard_negatives,
        op13_quality_classifier,
    )
}

_OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
b AS (
  SELECT line, min(doc_id * 1000000000 + pos) FILTER (WHERE doc_id IS NOT NULL) AS first FROM l
  WHERE regexp_matches(line, '([^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]+){2}[^ \t\n\x0b\f\r]')
  GROUP BY line HAVING count(DISTINCT source) >= 10),
r AS (
  SELECT l.doc_id, count(*) AS n_lines, count(b.line) FILTER (WHERE l.doc_id * 1000000000 + l.pos <> b.first) AS n_removed,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE b.line IS NULL OR l.doc_id * 1000000000 + l.pos = b.first), '') AS text
  FROM l LEFT JOIN b ON l.line = b.line GROUP BY l.doc_id)
SELECT d.doc_id, r.text, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
"""

_OP10_SQL = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 'b', item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark WHERE text IS NOT NULL),
s AS (
  SELECT DISTINCT side, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) >= 5
  UNION
  SELECT side, id, array_to_string(w, ' ') FROM w WHERE side = 'b' AND len(w) BETWEEN 1 AND 4
  UNION
  SELECT side, id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) FROM w
    JOIN (SELECT DISTINCT len(w) AS k FROM w WHERE side = 'b' AND len(w) BETWEEN 1 AND 4) ON len(w) >= k WHERE side = 'd'),
n AS (SELECT id, count(*) AS n_shingles FROM s WHERE side = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared, any_value(n.n_shingles) AS n_shingles, count(*) / any_value(n.n_shingles) AS containment
FROM s d JOIN s b ON d.s = b.s AND d.side = 'd' AND b.side = 'b' JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING count(*) / any_value(n.n_shingles) >= 0.8
"""

_TERMS = r"""list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

_OP11_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT count(*) AS big, sum(len(w)) AS l FROM d WHERE len(w) > 0),
q AS MATERIALIZED (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY 1, 2),
t AS MATERIALIZED (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY 1, 2, 3, 4),
f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, g GROUP BY 1),
p AS MATERIALIZED (SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + CAST((25 * n * big) // l AS BIGINT)))) AS part FROM t JOIN f USING (term), g),
s AS (SELECT item_id, r, doc_id, sum(times * part) AS score FROM p JOIN q USING (term) GROUP BY 1, 2, 3)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS k FROM s WHERE score > 0) WHERE k <= 20
"""

ORACLE_SQL: dict[str, str] = {"op5_line_dedup": _OP5_SQL, "op10_decontamination": _OP10_SQL, "op11_ranked_search": _OP11_SQL}
