"""Splits that no repeated answer crosses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.text import hash_split
from corpuslake.operators.tables import min_labels


def group_key(source: Column, scene: Column, voice: Column | None = None) -> Column:
    """voice:<scene> for single lines, scene:<source>:<scene> for the rest; empty parts are unknown."""
    part = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("unknown"))
    scene_key = F.concat(F.lit("scene:"), part(source), F.lit(":"), part(scene))
    return scene_key if voice is None else F.when(voice, F.concat(F.lit("voice:"), part(scene))).otherwise(scene_key)


def linked_groups(rows: DataFrame, group: str, text_key: str) -> DataFrame:
    """(group, component) for all groups: those that share a text key are one component, named by its smallest group.

    text_key is null where a text is too short to link. Keys of one group only never enter the loop."""
    pairs = rows.where(F.col(text_key).isNotNull()).select(group, text_key).distinct()
    shared = pairs.groupBy(text_key).count().where("count > 1").select(text_key)
    labels = min_labels(pairs.join(shared, text_key), group, text_key)
    return rows.select(group).distinct().join(labels.withColumnRenamed("node", group), group, "left").withColumn("component", F.coalesce("component", group))


def leakfree_split(rows: DataFrame, group: str, text_key: str, seed: str, validation: float, test: float) -> DataFrame:
    """Rows with component and split, which is drawn for the component."""
    parts = linked_groups(rows, group, text_key).withColumn("split", hash_split(F.col("component"), seed, validation, test))
    return rows.join(parts, group)


def leaks(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys in more than one split."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("n_rows")).where("splits > 1")


def manifest(rows: DataFrame, split: str, group: str, chars: Column) -> DataFrame:
    """Rows, groups and characters of each split."""
    return rows.groupBy(split).agg(F.count("*").alias("n_rows"), F.count_distinct(group).alias("n_groups"), F.sum(chars).alias("n_chars"))
