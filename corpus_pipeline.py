"""Corpus pipeline: quality rules, language ID, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforensics.llm import language, packing, repetition, simhash
from docforensics.llm.queries import vocabulary

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _kept(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f"in_{c}").alias(c) for c in COLUMNS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go; repeated rows are judged alike, null ids stay."""
    return _kept(repetition.quality_rules(docs, keep=COLUMNS).where("kept"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without a letter, or between two languages, go.

    The languages are learned from all documents given that aren't held out and have a lang. If
    there is none, nothing can be told and all go. Rows with null ids are judged, not learned from.
    """
    model = language.fit(docs.where(~language.held_out("doc_id") & F.col("doc_id").isNotNull()))
    return _kept(language.predict(docs, model, keep=COLUMNS).where("lang_pred <> 'und' and not ambiguous"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.

    Null ids have no smallest, so such a document stays only if its group has no id at all. Rows
    repeated under the smallest id are one document: the first by n_chars, text, lang and source stays.
    """
    marked = simhash.simhash_components(docs, keep=COLUMNS)
    stays = marked.where("doc_id = component_id or component_id is null")
    columns = F.struct(*(F.col(f"in_{c}").alias(c) for c in COLUMNS))
    order = F.struct("in_n_chars", "in_text", "in_lang", "in_source")
    # Groups without an id are told apart by fingerprint
    return stays.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp")).agg(F.min_by(columns, order).alias("d")).select("d.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in sequences of 1024 tokens; null ids and texts are packed too."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("language", known_language), ("near-duplicates", one_of_each), ("packing", pack)]

#: Suffix arrays, fingerprints, the language model and tokens aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
