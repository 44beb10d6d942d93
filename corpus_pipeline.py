"""From raw documents to token shards: five stages, each written as Parquet and read again by the next.

Every stage works on all rows that the one before it kept, and all but the last return the columns of documents. The
result, one row per kept document, is what reading the token shards back gives. The stages find languages, near copies,
test-item leaks, a mixed order and token ids; none but the order depends on another's thresholds.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, jaccard, language, mixing, tokens
from tidewatch.llm.store import kept


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that a learned language explains better than chance; text without a letter goes.

    Languages are learned from the documents outside the held-out quarter that name one.
    """
    return language.keep_known(docs, language.train(docs.where(~language.held_out())))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep, of every group that links of shingle similarity 0.8 or more connect, the document of smallest id.

    Documents with a null id stay when their group has no id at all. Of rows that repeat a kept id, one row stays,
    unless it has no words: those link with nothing.
    """
    found = jaccard.jaccard_components(docs)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_rows"), F.max("n_shingles").alias("_size"))
    met = docs.select(F.struct("*").alias("row"), "doc_id").join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")))
    once = (F.col("_rows") == 1) | F.col("doc_id").isNull() | (F.col("_size") == 0)
    again = met.where(~once).groupBy("doc_id").agg(F.min_by("row", F.xxhash64("row.text")).alias("row"))
    return met.where(once).select("row.*").unionByName(again.select("row.*"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no copy of a test item, verbatim or edited."""
    leaks = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    own = "_leak_" + "_".join(docs.columns)         # no column of docs
    leaks = leaks.select(F.col("doc_id").alias(own)).distinct()
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col(own)), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order in which Pfair scheduling lets the sources' blocks follow one another."""
    return mixing.in_order(mixing.mixed(docs))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in the order of the files that the stage before wrote, read back: one row per document.

    Rows that come from no file have no written order; they are taken by doc_id.
    """
    try:
        name = F.col("_metadata.file_name")
        docs = docs.select("doc_id", "text", F.regexp_extract(name, r"part-(\d+)", 1).cast("long").alias("_part"), name.alias("_file"),
                           F.col("_metadata.row_index").alias("_row"))
        order = ["_part", "_file", "_row"]
        docs.schema
    except AnalysisException:
        order = None
    return tokens.token_shards(docs, tokens.vocabulary_of(spark), order=order)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", write_tokens),
]

#: Language models, alignment and token ids cannot be told in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), "pipeline")
    return docs
