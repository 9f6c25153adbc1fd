"""A training corpus from documents in five stages, each over all that the one before kept.

The first four are filters and return the columns of documents; the last returns the packed pieces.  The benchmark filter
drops documents with hit words rather than cutting the passages out, as what is left of such a text reads broken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutloom.llm import decontaminate, language, neardup, packing, quality
from cutloom.llm.common import staged, table, tokenizer_path


#: As many ids that stand on several rows are sent to every task; more are joined by a shuffle.
SENT_IDS = 500_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; learnt from labels of documents."""
    trees = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.keep_good(docs, trees)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that most of their words share."""
    return language.keep_identified(docs, language.train(docs))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; of several rows with its id the smallest by text and other columns,
    one without a text last."""
    plain = docs.select(F.col("doc_id").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    kept = neardup.near_duplicates(docs, (80, 100)).filter("kept and doc_id is not null")
    kept = staged(kept.groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_times")), "kept")
    same = F.col("_id").cast("long") == F.col("_kept")
    # Kept ids grow with the documents, so they are never sent to all tasks: texts move once, to small tables of ids.
    once = plain.join(kept.filter("_times = 1").hint("shuffle_hash"), same, "left_semi")
    # Rows without an id can't be told apart and stay.
    out = once.unionByName(plain.filter(F.col("_id").isNull()))
    several = kept.filter("_times > 1")
    n = several.count()
    if n:  # only rows that share an id move a second time, the smallest of each task
        few = F.broadcast(several) if n <= SENT_IDS else several.hint("shuffle_hash")
        order = Window.partitionBy("_id").orderBy(F.col("_row.text").isNull(), "_row.text", F.to_json("_row"))
        first = plain.join(few, same, "left_semi").withColumn("_first", F.row_number().over(order))
        out = out.unionByName(first.filter("_first = 1").drop("_first"))
    return out.select("_row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 ids."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("neardup", neardup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Learnt models and sketches have no SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
