"""Reports: totals, inventories, coverage, reconciliation, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def character_totals(rows: DataFrame, split: str) -> DataFrame:
    """Characters of prompts and completions by split."""
    prompt = F.aggregate("prompt", F.lit(0), lambda a, m: a + F.length(m["content"]))
    return rows.groupBy(split).agg(F.sum(prompt).alias("prompt_chars"), F.sum(F.length("completion.content")).alias("completion_chars"))


def branch_inventory(strings: DataFrame, value: str, place: str, examples: int = 5) -> DataFrame:
    """Each distinct inline branch {M#a}{F#b}: how often it occurs, both readings and its first examples.

    Examples are ranked inside partial groups first, so a branch of a third of all rows sends a few rows to its task."""
    form = r"(\{M#[^{}]*\}\{F#[^{}]*\})"
    hits = strings.select(place, F.explode(F.regexp_extract_all(value, F.lit(form), F.lit(1))).alias("raw"))
    counts = hits.groupBy("raw").agg(F.count("*").alias("occurrences"))
    ranked = hits.distinct().withColumn("r", F.row_number().over(W.partitionBy("raw").orderBy(place))).where(F.col("r") <= examples)
    first = ranked.groupBy("raw").agg(F.array_sort(F.collect_list(place)).alias("examples"))
    side = lambda x: F.regexp_extract("raw", rf"\{{{x}#([^{{}}]*)\}}", 1)
    return counts.join(first, "raw").select("raw", "occurrences", side("M").alias("male"), side("F").alias("female"), "examples")


def coverage(source: DataFrame, key: str, rows: DataFrame, ids: str) -> DataFrame:
    """How many source ids the rows cover (ids is an array: merged lines carry several), and how many they don't."""
    used = rows.select(F.explode(ids).alias(key)).distinct().withColumn("_used", F.lit(True))
    both = source.select(key).distinct().join(used, key, "left")
    return both.agg(F.count("*").alias("source_ids"), F.count_if(F.col("_used").isNotNull()).alias("covered_ids"), F.count_if(F.col("_used").isNull()).alias("excluded_ids"))


def reconciled(raw: DataFrame, extracted: DataFrame, key: str) -> DataFrame:
    """Files whose independent count of targets is not the number of rows extracted; reading them raises nothing, an empty result is good."""
    a, b = raw.groupBy(key).agg(F.sum("n").alias("expected")), extracted.groupBy(key).agg(F.count("*").alias("found"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
    return both.where("expected <> found")


def scan_report(files: DataFrame, file: str, bad: DataFrame, turns: DataFrame, occurrences: DataFrame) -> DataFrame:
    """One row on a scan: files read, unreadable ones, files with a target, target turns found by an independent count (turns: file, n), rows extracted.

    Counts are partial sums; no list of files is gathered."""
    hit = turns.groupBy(file).agg(F.sum("n").alias("n")).where("n > 0").agg(F.count("*").alias("files_with_target"), F.coalesce(F.sum("n"), F.lit(0)).alias("target_turns"))
    parts = [files.agg(F.count_distinct(file).alias("files_read")), bad.agg(F.count_distinct(file).alias("files_unreadable")), hit, occurrences.agg(F.count("*").alias("rows_extracted"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, F.lit(True))
    return out


def assessment_audit(assessments: DataFrame, key: str, restricted: Column, tier: str | None = None, cards: DataFrame | None = None) -> dict[str, DataFrame]:
    """Counts by status, mode and (of cards) tier, warnings for restricted facts that are called common, errors for direct evidence without a scene."""
    out = {
        "status_counts": assessments.groupBy("epistemic_status").count(), "mode_counts": assessments.groupBy("response_mode").count(),
        "warnings": assessments.where(restricted & (F.col("epistemic_status") == "common")).select(key, "fact_id"),
        "errors": assessments.where((F.col("epistemic_status") == "firsthand") & (F.size("evidence_scene_ids") == 0)).select(key, "fact_id"),
    }
    return out | ({"tier_counts": cards.groupBy(tier).count()} if tier is not None and cards is not None else {})


def verdict_report(reviews: DataFrame, before: str, after: str) -> tuple[DataFrame, DataFrame]:
    """Verdicts with text lengths before and after, and issue types."""
    verdicts = reviews.groupBy("verdict").agg(F.count("*").alias("n"), F.sum(F.length(before)).alias("chars_before"), F.sum(F.length(after)).alias("chars_after"))
    return verdicts, reviews.select(F.explode("issues").alias("i")).groupBy("i.issue_type").count()


def bundles(keys: DataFrame, key: str, parts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """One row a key with a sorted list of structs and its size for each part; keys without rows have empty lists, and a lineage hash is over all lists."""
    out = keys
    for name, (rows, fields) in parts.items():
        lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array())).withColumn(f"n_{name}", F.size(name))
    return out.withColumn("bundle_sha256", F.sha2(F.to_json(F.struct(*parts)), 256))


def variant_overlap(variants: dict[str, tuple[DataFrame, DataFrame]], key: str) -> DataFrame:
    """base, added, skipped and combined counts of each variant of an append."""
    rows = None
    for name, (base, more) in variants.items():
        flagged = more.join(base.select(key).distinct().withColumn("_in", F.lit(True)), key, "left").agg(F.count_if(F.col("_in").isNull()).alias("added"), F.count_if(F.col("_in").isNotNull()).alias("skipped"))
        one = base.agg(F.count("*").alias("base")).join(flagged, F.lit(True)).select(F.lit(name).alias("variant"), "base", "added", "skipped", (F.col("base") + F.col("added")).alias("combined"))
        rows = one if rows is None else rows.union(one)
    return rows


def names_by_tier(cards: DataFrame, tier: str, name: str, tiers: DataFrame, order: str) -> DataFrame:
    """Sorted names of every tier in the given order; empty tiers shown."""
    names = cards.groupBy(tier).agg(F.array_join(F.array_sort(F.collect_list(name)), "、").alias("names"))
    return tiers.join(names, tier, "left").select(order, tier, F.coalesce("names", F.lit("")).alias("names")).orderBy(order)


def assembly_report(rows: DataFrame, status: str, conflicts: str) -> DataFrame:
    return rows.agg(F.count_if(F.col(status) == "included").alias("included"), F.count_if(F.col(status) == "excluded").alias("excluded"), F.count_if(F.col(status) == "failed").alias("failed"), F.count_if(F.size(conflicts) > 0).alias("with_conflicts"))
