"""A training corpus from `documents`: five stages, each on all that the one before it kept.

1. toxicity: documents the classifier rejects (score 0.5 or more) go.
2. near duplicates: of each component of near copies the document with the smallest id stays (a component of null ids
   stays whole; of rows with one id and one text, one stays).
3. substring dedup: words of 50-word passages that a document with a smaller id has are cut out. A text that loses words
   is its words left, joined by one space; others stay as they are. No document is dropped, even if nothing is left.
4. benchmark decontamination: documents with a leaked item go.
5. packing: the rest becomes pieces in sequences of at most 4096 tokens.

Stages 1 to 4 return the columns of their input; `n_chars` follows the text. Null and empty texts pass stages 1 to 4 and
are packed as an end token. Between stages the rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldledger.llm.common import saved, table
from fieldledger.llm.jaccard_tree import near_components
from fieldledger.llm.packing import pack_documents
from fieldledger.llm.recompression import remove_repeats
from fieldledger.llm.template_leaks import leaks
from fieldledger.llm.toxicity import scored


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return scored(docs, table(spark, sf_dir, "labels")).where("score < 0.5").select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    near = near_components(docs)
    stays = near.where("component_id is null or component_id = doc_id").select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.join(stays, docs["doc_id"].eqNullSafe(F.col("_id")), "left_semi").withColumn("_text", F.xxhash64("text"))
    one = F.row_number().over(Window.partitionBy("doc_id", "_text").orderBy("_text"))
    return kept.withColumn("_n", F.when(F.col("doc_id").isNull(), 1).otherwise(one)).where("_n = 1").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = F.col("n_removed") > 0
    out = remove_repeats(docs).withColumn("text", F.when(cut, F.col("kept")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    found = leaks(keyed.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(found.select(F.col("doc_id").alias("_key")).distinct(), "_key", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("toxicity", keep_clean), ("near_duplicates", keep_one_of_near_copies), ("substring_dedup", cut_repeats), ("decontamination", drop_leaks), ("packing", pack)]

#: SQL can express neither the classifier nor the tokenizer; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
