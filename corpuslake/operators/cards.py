"""Cards: trigger ownership, relationship nodes, facts by response mode, reviews and their lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trigger_owners(triggers: DataFrame, trigger: str, owner: str, priority: str, derived: int = 20) -> DataFrame:
    """trigger (folded), priority of its winners, number of winners and the winners, sorted; a derived trigger with more than one is dropped.

    The greatest priority is an aggregate with partial sums, not a window, so a trigger of many cards is no single task's work."""
    folded = triggers.select(F.lower(trigger).alias(trigger), owner, priority)
    best = folded.groupBy(trigger).agg(F.max(priority).alias(priority))
    won = folded.join(best, [trigger, priority]).groupBy(trigger, priority).agg(F.count_distinct(owner).alias("n_owners"), F.min(owner).alias("first_owner"))
    return won.where((F.col(priority) > derived) | (F.col("n_owners") == 1)).withColumn("shared", F.col("n_owners") > 1)


def collisions(triggers: DataFrame, trigger: str, owner: str) -> DataFrame:
    return triggers.groupBy(F.lower(trigger).alias(trigger)).agg(F.count_distinct(owner).alias("n_owners")).where("n_owners > 1")


def relationship_nodes(roster: DataFrame, key: str, impressions: DataFrame, excluded: DataFrame, scan: DataFrame) -> DataFrame:
    """Each roster entity with its status: impression, excluded, scanned (it occurs in scenes) or unknown. The sides must have unique keys;
    an entity with an impression that is excluded too is an error, told by contradictions()."""
    out = roster.join(impressions, key, "left").join(excluded, key, "left").join(scan, key, "left")
    status = F.when(F.col("impression").isNotNull(), "impression").when(F.col("exclusion").isNotNull(), "excluded").when(F.coalesce("scenes", F.lit(0)) > 0, "scanned").otherwise("unknown")
    return out.withColumn("status", status)


def contradictions(impressions: DataFrame, excluded: DataFrame, roster: DataFrame, key: str) -> DataFrame:
    both = impressions.join(excluded, key, "left_semi").select(key, F.lit("impression and exclusion").alias("problem"))
    return both.union(impressions.join(roster, key, "left_anti").select(key, F.lit("not in the roster").alias("problem")))


def counts_of_all(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """Counts for all known values, zeros kept."""
    return known.select(key).join(rows.groupBy(key).count(), key, "left").select(key, F.coalesce("count", F.lit(0)).alias("n"))


def contacts_by_region(nodes: DataFrame, region: str, name: str, allowed: Column, regions: DataFrame) -> DataFrame:
    """Names that may be contacted in each region, sorted; a region with none has ''."""
    names = nodes.where(allowed).groupBy(region).agg(F.array_join(F.array_sort(F.collect_list(name)), ",").alias("contacts"))
    return regions.select(region).join(names, region, "left").select(region, F.coalesce("contacts", F.lit("")).alias("contacts"))


def facts_by_mode(assessments: DataFrame, facts: DataFrame, key: list[str], mode: str, text: str, order: str) -> DataFrame:
    """Facts of each card by response mode, in order; facts without a text are dropped."""
    own = assessments.join(facts, key).where(F.col(text).isNotNull())
    items = F.array_sort(F.collect_list(F.struct(order, text)))
    return own.groupBy(key[0], mode).agg(F.transform(items, lambda s: s[text]).alias("facts"))


def apply_reviews(cards: DataFrame, reviews: DataFrame, key: str, text: str, phrases: list[tuple[str, str]] | None = None) -> DataFrame:
    """The reviewers' replacement where there is one, else the text as it is; verdict not_in_round for cards without a review.
    phrases: (old, new) pairs, replaced literally and in order in what cards to be revised say in the end."""
    out = cards.join(reviews.select(key, "verdict", "replacement"), key, "left")
    new = F.when((F.col("verdict") == "revise") & (F.coalesce("replacement", F.lit("")) != ""), F.col("replacement")).otherwise(F.col(text))
    cut = new
    for old, fresh in phrases or []:
        cut = F.replace(cut, F.lit(old), F.lit(fresh))
    new = F.when(F.col("verdict") == "revise", cut).otherwise(new)
    return out.withColumn(text, new).withColumn("verdict", F.coalesce("verdict", F.lit("not_in_round"))).drop("replacement")


def answer_context(touched: DataFrame, named: DataFrame, answer: str, card: str, texts: DataFrame, text: str, excluded: str) -> DataFrame:
    """(answer, cards, context): the cards that the user's turn touched or the answer names, one excluded, and their texts joined in order of id."""
    both = touched.select(answer, card).union(named.select(answer, card)).distinct().where(F.col(card) != excluded)
    held = F.array_sort(F.collect_list(F.struct(F.col(card).alias("card"), F.col(text).alias("text"))))
    out = both.join(texts.select(card, text), card).groupBy(answer).agg(held.alias("held"))
    return out.select(answer, F.transform("held", lambda h: h["card"]).alias("cards"), F.array_join(F.filter(F.transform("held", lambda h: h["text"]), lambda t: F.coalesce(t, F.lit("")) != ""), "\n\n").alias("context"))


def lineage(cards: DataFrame, key: str, text: str, final: str, rounds: list[DataFrame]) -> DataFrame:
    """Each card's route over the review rounds and whether its final text is the one that the rounds lead to.

    A round is (key, verdict, replacement). pass ends the route; after revise the next round must have a review."""
    out, expected, route, going, error = cards, F.col(text), F.lit(""), F.lit(True), F.lit(None).cast("string")
    for i, r in enumerate(rounds, 1):
        out = out.join(r.select(key, F.col("verdict").alias(f"v{i}"), F.col("replacement").alias(f"r{i}")), key, "left")
        v = F.col(f"v{i}")
        error = F.coalesce(error, F.when(going & v.isNull(), F.lit(f"round {i} is missing")).when(~going & v.isNotNull(), F.lit(f"round {i} after a pass")))
        expected = F.when(going & (v == "revise"), F.coalesce(f"r{i}", F.lit(""))).otherwise(expected)
        route = F.concat(route, F.when(going, F.coalesce(F.substring(v, 1, 1), F.lit("-"))).otherwise(F.lit("")))
        going = going & F.coalesce(v == "revise", F.lit(False))
    error = F.coalesce(error, F.when(going, F.lit("no final pass")), F.when(~F.col(final).eqNullSafe(expected), F.lit("text differs")))
    return out.select(key, route.alias("route"), error.alias("error"))
