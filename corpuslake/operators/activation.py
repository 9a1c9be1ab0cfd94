"""Cards that conversations activate: least-recently-used sets in batch, longest-match shadowing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslake.operators.tables import settled


def active_sets(touches: DataFrame, session: str, order: list[str], card: str, size: int) -> DataFrame:
    """The final active set of each session: its `size` most recently touched cards, newest first (rank 1).

    An LRU set is the top of the last touches, so one aggregate per (session, card) with partial sums says it all;
    where touches are equal in order the greater card is newer."""
    last = touches.groupBy(session, card).agg(F.max(F.struct(*order)).alias("at"))
    rank = F.row_number().over(W.partitionBy(session).orderBy(F.desc("at"), F.desc(card)))
    return last.withColumn("rank", rank).where(F.col("rank") <= size)


def active_after_each(touches: DataFrame, session: str, order: str, card: str, size: int) -> DataFrame:
    """The active set after every touch, newest first. Sessions are sorted and walked in one pass; what is carried along is one set
    of at most `size` cards, so a session of any length needs no memory of its own."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for rows in batches:
            sets = []
            for who, what in zip(rows[session], rows[card], strict=True):
                held = [what, *(x for x in held if x != what)][:size] if who == now else [what]
                now = who
                sets.append(held)
            yield rows.assign(active=pd.Series(sets, dtype=object, index=rows.index))

    ordered = touches.repartition(session).sortWithinPartitions(session, order)
    kind = touches.schema[card].dataType.simpleString()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in touches.schema)
    return ordered.mapInPandas(walk, f"{fields}, active array<{kind}>")


def containment(aliases: DataFrame, alias: str) -> DataFrame:
    """(inner, outer): which aliases stand inside which longer ones. Each alias sends its substrings of the lengths that aliases have, and they meet
    the aliases by equality; so the work is the aliases' characters times those lengths, and no two aliases are compared."""
    own = settled(aliases.select(F.col(alias).alias("outer")).where(F.length(alias) > 0).distinct(), "aliases")
    lengths = own.select(F.length("outer").alias("n")).distinct().agg(F.sort_array(F.collect_list("n")).alias("lengths"))
    parts = lambda n: F.transform(F.sequence(F.lit(1), F.length("outer") - n + 1), lambda i: F.substring("outer", i, n))
    every = F.array_distinct(F.flatten(F.transform(F.filter("lengths", lambda n: n < F.length("outer")), parts)))
    inside = own.join(F.broadcast(lengths), F.lit(True)).select("outer", F.explode(every).alias("inner"))
    return inside.join(own.select(F.col("outer").alias("inner")), "inner").select("inner", "outer")


def longest_matches(matches: DataFrame, text_id: str, card: str, alias: str, inside: DataFrame | None = None) -> DataFrame:
    """Each text's longest matched alias of each card (bytes, then the smaller alias), less the cards whose alias lies inside a
    longer matched alias of another card.

    inside: containment() of the aliases, which can be built once and kept; without it, it is built of the matched ones. A match looks up the
    aliases that its own lies in, and those of its text drop it; a card has one alias a text, so another alias is another card's."""
    best = matches.groupBy(text_id, card).agg(F.min_by(alias, F.struct(-F.octet_length(alias), F.col(alias))).alias(alias))
    # written once, as it is read four times and the matches need a pass over the texts
    best = settled(best, "longest")
    inside = containment(best, alias) if inside is None else inside
    longer = best.select(F.col(text_id), F.col(alias).alias("outer")).distinct()
    shadowed = best.select(text_id, alias).distinct().join(inside.withColumnRenamed("inner", alias), alias).join(longer, [text_id, "outer"], "left_semi").select(text_id, alias).distinct()
    return best.join(shadowed, [text_id, alias], "left_anti").select(text_id, card, alias)
