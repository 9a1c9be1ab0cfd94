"""One row of many: canonical rows by id, unique rows by text, conflicts, append without repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def canonical(rows: DataFrame, key: str, order: list[Column], source: str, fallback: list[str] | None = None) -> DataFrame:
    """The first row of each key (a string, or an array of ids) in the order, with all sources (sorted) and the number of rows.

    A null or empty key never groups; its rows group by the fallback columns, or stay alone without any. An aggregate with partial sums, so a key with a third of all rows is no single task's work.
    Rows must differ in the order, else any of the tied ones is chosen."""
    own = [c for c in rows.columns if c != key]
    # a row without a key is a group of its own, so one aggregate reads the rows once
    empty = F.size(key) == 0 if isinstance(rows.schema[key].dataType, ArrayType) else F.col(key).cast("string") == ""
    missing = F.coalesce(empty, F.lit(True))
    alone = F.when(missing, F.struct(*fallback) if fallback else F.monotonically_increasing_id())
    keyed = rows.withColumn("_alone", alone)
    picked = keyed.groupBy(key, "_alone").agg(F.min_by(F.struct(*own), F.struct(*order)).alias("r"), F.array_sort(F.collect_set(source)).alias("duplicate_sources"), F.count("*").alias("source_occurrence_count"))
    return picked.select(key, *(F.col(f"r.{c}").alias(c) for c in own), "duplicate_sources", "source_occurrence_count")


def conflicts(rows: DataFrame, key: str, *fields: str) -> DataFrame:
    """Keys that stand for more than one value of a field, with the number of values of each."""
    n = [F.count_distinct(f).alias(f"n_{f}") for f in fields]
    some = F.lit(False)
    for f in fields:
        some = some | (F.col(f"n_{f}") > 1)
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*n).where(some)


def unique_texts(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row (by order) of each text key: key, order column and the number of rows. Copies are listed by copies_of()."""
    return rows.groupBy(key).agg(F.min(order).alias(order), F.count("*").alias("text_occurrence_count"))


def copies_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """A row for each copy that is not the first: the first row's id beside its own. Long form, so no group is gathered."""
    first = unique_texts(rows, key, order).where("text_occurrence_count > 1").select(key, F.col(order).alias(f"first_{order}"))
    return rows.join(first, key).where(F.col(order) != F.col(f"first_{order}"))


def append_new(base: DataFrame, more: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """base with those rows of more whose key is new (the first of each), and the rows that were skipped."""
    first = more.groupBy(key).agg(F.min(order).alias(order)).join(base.select(key), key, "left_anti")
    return base.unionByName(more.join(first, [key, order], "left_semi"), allowMissingColumns=True), more.join(first, [key, order], "left_anti")


def occurrence_summary(rows: DataFrame, key: str) -> DataFrame:
    """How many keys occur more than once, and on how many rows."""
    n = rows.groupBy(key).count().where("count > 1")
    return n.agg(F.count("*").alias("repeated_texts"), F.coalesce(F.sum("count"), F.lit(0)).alias("repeated_rows"))


def occurrence_histogram(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("texts"))
