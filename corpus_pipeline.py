"""A corpus pipeline over documents: quality rules, n-gram join, decontamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and returns a DataFrame that is written
as Parquet and read again. All but the last return the columns of documents, and further ones of whatever name; the last returns the shards' rows.

Null or empty texts fail the quality rules, and so do rows without a doc_id go. Rows that repeat a doc_id go or stay together: where one of them
passes the quality rules, the others pass as well; the near-copy stage looks at the smallest set of them, the decontamination at all of them,
and the mix deals what it takes over them. Ties among near copies: the smallest doc_id stays. Very long texts count as a whole in every stage.
An empty table passes all stages and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.decontamination import contaminated
from tessera.llm.entry import vocabulary
from tessera.llm.mixing import mix_sources
from tessera.llm.quality_rules import quality_rules
from tessera.llm.shared import Scratch
from tessera.llm.signature_join import jaccard_components
from tessera.llm.sstable import sstable_digest


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Needs a doc_id; rows without one go."""
    verdict = quality_rules(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = verdict.where("kept").select("doc_id").distinct()
    return docs.join(good.hint("merge"), "doc_id", "left_semi").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near copies: 5 words, similarity of 0.8 or more."""
    groups = jaccard_components(spark, docs, n=5, percent=80, counts=False)[0]
    lead = groups.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(lead.hint("merge"), "doc_id", "left_semi").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item, edited or exact."""
    found = contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").where("doc_id IS NOT NULL").distinct().hint("merge"), "doc_id", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a document as often as the mix takes it (0 to 3 times).

    Rows of one doc_id, source and size share what the mix takes of them: each as often, and one time more for the first in order of their texts.
    """
    names = docs.columns
    units = mix_sources(spark, docs).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size")).agg(F.sum("copies").alias("_all"), F.count("*").alias("_rows")).where("_all > 0")
    units = Scratch(spark, "mixed").cut(units, "units")
    sized = docs.withColumn("_words", F.expr(r"coalesce(regexp_count(text, '[^\\x20\\x09-\\x0D]+'), 0)").cast("long"))

    def taken(which: str) -> DataFrame:
        side = units.where(which).hint("merge")
        return sized.join(side, (F.col("doc_id") == F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size")))

    place = F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy("text"))
    alone = taken("_rows = 1").withColumn("_times", F.col("_all"))
    several = taken("_rows > 1").withColumn("_place", place).withColumn("_times", F.floor(F.col("_all") / F.col("_rows")) + F.when(F.col("_place") <= F.col("_all") % F.col("_rows"), 1).otherwise(0))
    both = alone.select(*names, "_times").union(several.select(*names, "_times")).where("_times > 0")
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(names)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix as SSTable shards, read back: doc_id, start, n_tokens, ids_crc32."""
    return sstable_digest(spark, docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
    ("token ids", token_shards),
]

#: SQL can't express the stages' alignment, sampling and encoding; the tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
