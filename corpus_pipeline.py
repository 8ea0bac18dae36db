"""A corpus pipeline over `documents`: quality, language, lines, near duplicates, packing.

Every stage works on all documents that the one before it kept, and its decisions take effect. Each
row is judged by its own text in the first two stages. In the others rows that share a doc_id count as
one document, and rows with a null doc_id keep their lines and are no duplicates. Null and empty texts
fail the quality rule; very long texts are worked on whole; columns beside those of documents are
carried along to the last stage, whatever their names; an empty table gives no sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm import language_id, line_dedup, ngram_join, packing, quality_rules
from cliploom.llm.common import BLANKS_SQL, discard, fresh, stored, work_tables
from cliploom.llm.queries import crc_rest, tokenizer_path

#: The least score of the predicted language, and how far the mixture of sources is flattened.
LEAST_SCORE, FLATTEN = 0.5, 0.7


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    name = fresh(docs, "gone")
    return docs.join(gone.select(F.col("doc_id").alias(name)).distinct(), F.col("doc_id") == F.col(name), "left_anti")


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one, so that none of their names meets an operator's."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("rest"))


def _back(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like` again, out of what _carried() made of them."""
    return docs.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in like.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay that neither fail the base rule nor are rejected by a rule learned from the labels of what is there."""
    kept, _ = quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return kept


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay whose language is known with a score of LEAST_SCORE or more."""
    net = language_id.train_network(docs.where(crc_rest("doc_id", 4) != 2))
    known = language_id.identify(_carried(docs), net).where((F.col("_lang") != language_id.UNKNOWN) & (F.col("_lang_score") >= LEAST_SCORE))
    return _back(known, docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go that a document of smaller id has, and documents of which no word is left; n_chars follows the text."""
    out = line_dedup.dedup_lines(_carried(docs))
    out = out.where((F.col("_n_dropped") == 0) | (F.btrim("text", F.expr(BLANKS_SQL)) != ""))
    return _back(out, docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id stays."""
    groups = ngram_join.jaccard_groups(docs)
    return _without(docs, groups.where(F.col("component_id") != F.col("doc_id")))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, mixed from the sources by flattened shares."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2, length=4096, flatten=FLATTEN)


STAGES = [("quality", quality), ("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("sequences", sequences)]

#: Learned stages and token ids can't be said in SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's work tables, and the table that it read, go when its own is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with work_tables() as made:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
            made.remove(docs)
        if before is not None:
            discard(before)
        before = docs
    return docs
