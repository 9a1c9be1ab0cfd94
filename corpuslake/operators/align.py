"""Two sides by id: pairs, left-overs, propagation of accepted ids, positional pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aligned(left: DataFrame, right: DataFrame, key: str, left_name: str = "left", right_name: str = "right") -> DataFrame:
    """key, the two rows as structs (null where a side lacks the id) and side: both, left or right. Keys must be unique."""
    side = lambda df, name: df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name))
    out = side(left, left_name).join(side(right, right_name), key, "full_outer")
    which = F.when(F.col(right_name).isNull(), "left").when(F.col(left_name).isNull(), "right").otherwise("both")
    return out.withColumn("side", which)


def accepted(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key), key, "left_semi")


def back_joined(rows: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Rows with their source row; a missing source is an error that names its key, raised where the row is read."""
    found = rows.join(source.withColumn("_found", F.lit(True)), key, "left")
    return found.withColumn(key, F.when(F.col("_found"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"no source row for {key} "), F.col(key).cast("string"))))).drop("_found")


def paired_scenes(left: DataFrame, right: DataFrame, ids: str, turns: str) -> DataFrame:
    """Scenes paired on their sorted set of turn ids, left outer; turns paired by id, with '' for absent texts (the right's are prefixed)."""
    key = lambda df: df.withColumn("scene_key", F.array_sort(F.array_distinct(F.col(ids))))
    a, b = key(left), key(right).select("scene_key", F.col(turns).alias("other_turns"))
    a = a.join(b, "scene_key", "left").withColumn("counterpart_found", F.col("other_turns").isNotNull())
    flat = a.select("*", F.posexplode_outer(turns).alias("pos", "turn"))
    match = F.filter("other_turns", lambda t: t["id"] == F.col("turn")["id"])
    return flat.withColumn("other_text", F.coalesce(F.get(match, F.lit(0))["text"], F.lit(""))).withColumn("other_speaker", F.coalesce(F.get(match, F.lit(0))["speaker"], F.lit("")))


def zipped(left: DataFrame, right: DataFrame, position: str) -> DataFrame:
    """Two lists of one length by position; rows without a partner are an error."""
    out = left.join(right, position, "full_outer")
    width = [c for c in out.columns if c != position]
    both = F.lit(True)
    for side in (left, right):
        both = both & F.greatest(*(F.col(c).isNotNull() for c in side.columns if c != position), F.lit(False))
    return out.select(F.when(both, F.col(position)).otherwise(F.raise_error(F.lit("the lists differ in length"))).alias(position), *width)
