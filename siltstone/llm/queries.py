"""The operators as queries over the whole tables, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, exact_dedup, language_id, lm_score, mixing, ngram_join, packing, token_ids, topk_search, toxicity
from siltstone.llm.common import documents

#: Target weights of the registered mixture; all other sources have weight 1. src1 and src2 reach their caps.
WEIGHTS = {"src0": 2.0, "src1": 12.0, "src2": 8.0, "src3": 0.5}


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.encoded(documents(spark, sf_dir))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(documents(spark, sf_dir))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scored(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(documents(spark, sf_dir), WEIGHTS)


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of benchmark is a query."""
    return topk_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.kept(documents(spark, sf_dir)).select("doc_id", F.lower(F.hex("digest")).alias("digest"), "origin", "copies")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_token_ids, op2_ngram_jaccard_join, op3_lm_score, op4_mixing, op5_topk_search, op6_bpe, op7_toxicity, op8_sharding, op9_exact_dedup, op10_language_id)}

_WEIGHT = " ".join(f"WHEN '{s}' THEN {w}" for s, w in WEIGHTS.items())

ORACLE = {
    "op4_mixing": f"""
WITH sizes AS (SELECT source, CAST(SUM(n_chars) AS DOUBLE) AS size, CASE source {_WEIGHT} ELSE 1.0 END::DOUBLE AS w FROM documents GROUP BY source),
caps AS (SELECT *, size * {mixing.MAX_EPOCHS}::DOUBLE AS cap, size * {mixing.MAX_EPOCHS}::DOUBLE / w AS ratio, SUM(size) OVER () AS budget FROM sizes WHERE size > 0 AND w > 0),
levels AS (SELECT *, (budget - COALESCE(SUM(cap) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / SUM(w) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
final AS (SELECT MIN(ratio) AS ratio, ARG_MIN(level, ratio) AS level FROM levels WHERE level < ratio),
plan AS (SELECT source, CASE WHEN f.ratio IS NULL OR l.ratio < f.ratio THEN cap ELSE GREATEST(0.0, w * f.level) END / size AS r FROM levels l CROSS JOIN final f),
drawn AS (SELECT doc_id, d.source, CAST(FLOOR(r) AS BIGINT) + CASE WHEN CAST(('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 13)) AS BIGINT) / {1 << 52}::DOUBLE < r - FLOOR(r) THEN 1 ELSE 0 END AS n
          FROM documents d JOIN plan p ON d.source = p.source)
SELECT doc_id, source, CAST(UNNEST(generate_series(1, n)) AS INTEGER) AS copy FROM drawn""",
    "op5_topk_search": f"""
WITH words AS (SELECT doc_id, UNNEST(string_split_regex(trim(lower(text), e' \\n\\t\\r'), '\\s+')) AS w FROM documents),
tf AS (SELECT doc_id, w, COUNT(*) AS n FROM words WHERE w <> '' GROUP BY ALL), lengths AS (SELECT doc_id, SUM(n) AS len FROM tf GROUP BY doc_id),
stats AS (SELECT (SELECT COUNT(*) FROM documents) AS docs, (SELECT SUM(len) FROM lengths)::DOUBLE / (SELECT COUNT(*) FROM documents) AS mean),
asked AS (SELECT item_id, w, COUNT(*) AS times FROM (SELECT item_id, UNNEST(string_split_regex(trim(lower(text), e' \\n\\t\\r'), '\\s+')) AS w FROM benchmark) WHERE w <> '' GROUP BY ALL),
df AS (SELECT w, COUNT(*) AS df FROM tf WHERE w IN (SELECT w FROM asked) GROUP BY w),
found AS (SELECT item_id, tf.doc_id, ROUND(SUM(times * LN(1 + (docs - df + 0.5) / (df + 0.5)) * n * {topk_search.K1 + 1}::DOUBLE / (n + {topk_search.K1}::DOUBLE * (1 - {topk_search.B}::DOUBLE + {topk_search.B}::DOUBLE * len / mean))), 6) AS score
          FROM asked JOIN tf USING (w) JOIN df USING (w) JOIN lengths ON lengths.doc_id = tf.doc_id CROSS JOIN stats GROUP BY item_id, tf.doc_id),
ranked AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM found)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {topk_search.K}""",
    "op9_exact_dedup": """
WITH middle AS (SELECT (MIN(doc_id) + MAX(doc_id)) // 2 AS m FROM documents), stay AS (SELECT MIN(doc_id) AS doc_id, sha256(text) AS digest, COUNT(*) AS copies FROM documents GROUP BY text)
SELECT doc_id, digest, CASE WHEN doc_id <= m THEN 'history' ELSE 'incoming' END AS origin, copies FROM stay, middle""",
}
