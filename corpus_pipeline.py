"""From documents to a training mix: five stages over one table, each written and read again by its caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.common import fresh, materialize, read
from corpuslake.llm.decontaminate import contamination, row_key
from corpuslake.llm.language_id import identify, train
from corpuslake.llm.line_dedup import drop_shared_lines
from corpuslake.llm.mixing import mix
from corpuslake.llm.near_dedup import near_duplicates, row_ids

#: Words of a shingle in the near-duplicate stage, whose similarity is 0.8.
SHINGLE = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts are such), or far from every learned language, go. Learned from all documents with
    a lang; a null lang teaches nothing but is no reason to go. Repeated rows get equal decisions and all stay or all go."""
    found, names = identify(docs, train(docs))
    return found.where(~F.col(names["rejected"])).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents or more share stay in one; n_chars follows the text. Every document stays, null
    and empty texts as they are; repeated rows count as documents of their own and keep or lose the same lines."""
    found, names = drop_shared_lines(docs)
    changed = F.col(names["n_dropped"]) > 0
    new = {"text": F.when(changed, F.col(names["kept"])).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(names["kept"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns(new).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest doc_id; so do documents without words (null and
    empty texts). Of rows that share a doc_id one stays; a row without doc_id goes if it is like one that has one, or like another."""
    stays = near_duplicates(docs, SHINGLE).where("stays").select("row_id").distinct()
    key = fresh(docs.columns, "row_id")
    return docs.withColumn(key, row_ids()).join(stays.withColumnRenamed("row_id", key), key).dropDuplicates([key]).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items contaminate go. Null and empty texts have no words and stay; repeated rows stay or go together."""
    k, j = fresh(docs.columns, "k"), fresh(docs.columns, "j")
    bad = materialize(contamination(docs, read(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("k").alias(k), F.col("j").alias(j)).distinct(), "pipeline-contaminated")
    return docs.withColumns(dict(zip((k, j), row_key().values(), strict=True))).join(bad, [k, j], "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy taken, with the document's size, its source's size and target, and its copies. Null and empty texts have
    size 0 and are never taken; a null source is a source of its own; rows equal in doc_id and text are one document here."""
    return mix(docs)


STAGES = [("language", language), ("lines", lines), ("near", near), ("benchmark", benchmark), ("mixture", mixture)]
#: Language models and keyed samples can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
