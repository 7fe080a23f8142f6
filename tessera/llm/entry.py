"""Queries of this folder, one `opN_<name>` an operator, over whole tables, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Folder of the public vocabulary files; a parameter of the operators, never copied.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


def vocabulary(name: str) -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"{TOKENIZERS}/{name}"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.signature_join import jaccard_components

    return jaccard_components(spark, _documents(spark, sf_dir))[0]


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix_sources

    return mix_sources(spark, _documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_counts import token_counts

    return token_counts(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontamination import contaminated

    return contaminated(spark, _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_rules import quality_rules

    return quality_rules(spark, _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_sstable_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sstable import sstable_digest

    return sstable_digest(spark, _documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op7_prefix_free_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pfp_dedup import repeats_digest

    return repeats_digest(spark, _documents(spark, sf_dir))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import personal_data_digest

    return personal_data_digest(spark, _documents(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_classifier import quality_scores

    return quality_scores(spark, _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_dedup import line_dedup_digest

    return line_dedup_digest(spark, _documents(spark, sf_dir))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.importance import importance_sample

    return importance_sample(spark, _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import simhash_components

    return simhash_components(spark, _documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.collocations import collocations

    return collocations(spark, _documents(spark, sf_dir))


OP10_SQL = r"""
WITH lines AS (
  SELECT row_id, doc_id, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS line,
    translate(regexp_replace(regexp_replace(unnest(parts), '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), common AS (
  SELECT key FROM lines WHERE key <> '' AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT l.*, c.key IS NOT NULL AND doc_id IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON l.key = c.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_id
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_source_mixing, op3_trie_token_counts, op4_benchmark_decontamination, op5_risk_controlled_rules, op6_sstable_token_ids, op7_prefix_free_repeats, op8_personal_data, op9_quality_classifier, op10_line_dedup, op11_importance_resampling, op12_simhash_anchors, op13_phrase_collocations)}


def oracle_sql() -> dict[str, str]:
    from tessera.llm.collocations import ORACLE as op13
    from tessera.llm.quality_rules import ORACLE

    return {"op5_risk_controlled_rules": ORACLE, "op10_line_dedup": OP10_SQL, "op13_phrase_collocations": op13}
