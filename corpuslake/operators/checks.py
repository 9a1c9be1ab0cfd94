"""Checks of data and cards; each returns the violations, none stops at the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.text import any_of, fragment_ending, semantic_length
from corpuslake.operators.tables import IS_ARRAY, IS_OBJECT, recursive

#: Forms of private data that must not be published (defaults; a parameter).
PRIVATE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "home_path": r"/(home|Users)/[a-z]+", "api_key": r"\b(sk|AKIA)[A-Za-z0-9-]{16,}"}
TEXT_RULES = [("empty", r"^\s*$"), ("markup", r"\{[A-Z_]+(#[^}]*)?\}|<[^>]{1,80}>"), ("leading_hash", r"(^|\n)#"), ("replacement_character", "�"), ("control_character", r"[\x00-\x08\x0B-\x1F\x7F]")]


def violations(rows: DataFrame, key: str, rules: list[tuple[str, Column]], detail: Column | None = None) -> DataFrame:
    """(key, rule, detail) for each rule that a row breaks."""
    hit = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules)))
    return rows.select(key, F.explode(hit).alias("rule"), (detail if detail is not None else F.lit(None).cast("string")).alias("detail"))


def text_rules(text: Column) -> list[tuple[str, Column]]:
    return [(name, text.rlike(pattern)) for name, pattern in TEXT_RULES]


def sft_rules() -> list[tuple[str, Column]]:
    role = lambda i: F.get("prompt", F.lit(i))["role"]
    return [
        ("prompt_size", F.coalesce(F.size("prompt") != 2, F.lit(True))), ("prompt_roles", ~(role(0).eqNullSafe(F.lit("system")) & role(1).eqNullSafe(F.lit("user")))),
        ("completion_role", ~F.col("completion.role").eqNullSafe(F.lit("assistant"))), ("empty_content", F.coalesce(F.exists("prompt", lambda m: F.coalesce(m["content"], F.lit("")) == "") | (F.coalesce("completion.content", F.lit("")) == ""), F.lit(True))),
    ]


def private_hits(rows: DataFrame, key: str, text: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """Rows that hold private data, by form, with the number of hits."""
    items = [F.struct(F.lit(name).alias("pattern"), F.regexp_count(text, F.lit(p)).cast("long").alias("hits")) for name, p in (patterns or PRIVATE).items()]
    return rows.select(key, F.explode(F.array(*items)).alias("x")).where("x.hits > 0").select(key, "x.*")


def set_difference(a: Column, b: Column) -> Column:
    """Missing and foreign members of b against a."""
    return F.struct(F.array_sort(F.array_except(a, b)).alias("missing"), F.array_sort(F.array_except(b, a)).alias("foreign"))


def viewpoint_rules(allowed: dict[str, tuple[str, ...]], fact_ids: Column, assessments: Column, scenes: Column, identity: dict[str, tuple[Column, Column]] | None = None, unique: tuple[Column, ...] = (), text: Column | None = None, forbidden: tuple[str, ...] = ()) -> list[tuple[str, Column]]:
    """Identity and lineage fields (name -> stated, expected), lists without repeats, fact coverage, scenes that may be cited, status and
    mode that go together, direct evidence that needs a scene, words that must not stand in the text."""
    ids = F.transform(assessments, lambda a: a["fact_id"])
    fits = lambda a: F.coalesce(*(F.when(a["epistemic_status"] == s, a["response_mode"].isin(*modes)) for s, modes in allowed.items()), F.lit(False))
    rules = [(f"field_{name}", ~stated.eqNullSafe(expected)) for name, (stated, expected) in (identity or {}).items()]
    rules += [(f"repeated_string_{i}", F.size(F.array_distinct(xs)) != F.size(xs)) for i, xs in enumerate(unique)]
    rules += [
        ("missing_fact", F.size(F.array_except(fact_ids, ids)) > 0), ("foreign_fact", F.size(F.array_except(ids, fact_ids)) > 0), ("repeated_fact", F.size(F.array_distinct(ids)) != F.size(ids)),
        ("foreign_scene", F.exists(assessments, lambda a: F.size(F.array_except(a["evidence_scene_ids"], scenes)) > 0)), ("status_and_mode", F.exists(assessments, lambda a: ~fits(a))),
        ("firsthand_without_scene", F.exists(assessments, lambda a: (a["epistemic_status"] == "firsthand") & (F.size(a["evidence_scene_ids"]) == 0))),
    ]
    return rules + ([("forbidden_word", any_of(F.coalesce(text, F.lit("")), forbidden))] if text is not None else [])


def profile_rules(content: Column, prompt: Column, source: Column, category: Column, voice: str, last_line: str, combat: str, least: int = 10) -> list[tuple[str, Column]]:
    """Finished training rows of the direct-chat profile: enough said, no fragment at the end, a scene marks the line to be answered, no combat lines."""
    return [
        ("too_short", semantic_length(content) < least), ("fragment_ending", fragment_ending(content)),
        ("no_last_line", ~source.eqNullSafe(F.lit(voice)) & ~F.contains(prompt, F.lit(last_line))), ("combat_voice", (F.coalesce(category, F.lit("")) != "") & F.contains(prompt, F.lit(combat))),
    ]


def result_errors(decision: Column, card: dict[str, Column], expected: dict[str, Column], lists: dict[str, Column], forbidden: Column, formal: list[Column], needed: dict[str, Column]) -> Column:
    """All errors of an include/exclude result, in order: the decision, fields that differ from the candidate's, lists with forbidden
    names (whatever their case; null is no list), formal names missing in the first list, and for included cards what is empty."""
    low = F.transform(F.coalesce(forbidden, F.array().cast("array<string>")), F.lower)
    bad = lambda xs: F.array_sort(F.array_distinct(F.filter(xs, lambda x: F.array_contains(low, F.lower(x)))))
    names = next(iter(lists.values()))
    tests = [F.when(~F.coalesce(decision.isin("include", "exclude"), F.lit(False)), F.lit("unknown decision"))]
    tests += [F.when(~card[f].eqNullSafe(want), F.concat(F.lit(f"{f} is not "), F.coalesce(want, F.lit("null")))) for f, want in expected.items()]
    for f, xs in lists.items():
        tests.append(F.when(xs.isNull(), F.lit(f"{f} is no list")).when(F.size(bad(xs)) > 0, F.concat(F.lit(f"{f} holds forbidden names: "), F.array_join(bad(xs), ","))))
    tests.append(F.when(F.lit(False) if not formal else ~F.coalesce(F.forall(F.array(*formal), lambda n: F.array_contains(names, n)), F.lit(False)), F.lit("formal names are missing")))
    tests += [F.when((decision == "include") & (F.trim(F.coalesce(value, F.lit(""))) == ""), F.lit(f"included without {name}")) for name, value in needed.items()]
    return F.array_compact(F.array(*tests))


def missing_fields(cards: DataFrame, key: str, category: str, required: dict[str, tuple[str, ...]]) -> DataFrame:
    """(key, category, field): fields that a card of its category must have and that are null; cards are rows of one wide table."""
    parts = [F.when(F.col(category) == name, F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in fields)))) for name, fields in required.items()]
    return cards.select(key, category, F.explode(F.coalesce(*parts, F.array().cast("array<string>"))).alias("field"))


def category_counts(cards: DataFrame, category: str, expected: DataFrame, n: str = "expected") -> DataFrame:
    """(category, expected, found) where a category has not as many cards as it should, unknown categories included."""
    found = cards.groupBy(category).agg(F.count("*").alias("found"))
    both = expected.join(found, category, "full_outer").select(category, F.coalesce(n, F.lit(0)).cast("long").alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
    return both.where("expected <> found")


def lineage_differences(cards: DataFrame, key: str, stated: str, originals: DataFrame, actual: Column) -> DataFrame:
    """(key, stated, found): cards whose recorded hash is not that of the card they were made from (null: it is gone)."""
    both = cards.select(key, stated).join(originals.select(key, actual.alias("found")), key, "left")
    return both.select(key, F.col(stated).alias("stated"), "found").where(~F.col("stated").eqNullSafe(F.col("found")))


def split_problems(rows: DataFrame, split: str, ratios: dict[str, float], slack: float) -> DataFrame:
    """(split, n, share, problem): wanted splits that are empty or unknown, or whose share of all rows is off by more than slack.

    Ratios must be numbers from 0 to 1 that leave something for training, else this is an error before anything is read."""
    if any(not 0 <= r <= 1 for r in ratios.values()) or abs(sum(ratios.values()) - 1) > 1e-9:
        raise ValueError("ratios must lie between 0 and 1 and add up to 1")
    wanted = F.explode(F.map_from_entries(F.array(*(F.struct(F.lit(k), F.lit(float(v))) for k, v in ratios.items())))).alias(split, "wanted")
    found = rows.groupBy(split).agg(F.count("*").alias("n"))
    total = found.agg(F.sum("n").alias("total"))
    both = rows.sparkSession.range(1).select(wanted).join(found, split, "full_outer").join(F.broadcast(total), F.lit(True), "left")
    share = F.coalesce(F.col("n") / F.col("total"), F.lit(0.0))
    problem = F.when(F.col("wanted").isNull(), "unknown split").when(F.coalesce("n", F.lit(0)) == 0, F.when(F.col("wanted") > 0, "empty split")).when(F.abs(share - F.col("wanted")) > slack, "share out of bounds")
    return both.select(split, F.coalesce("n", F.lit(0)).cast("long").alias("n"), share.alias("share"), problem.alias("problem")).where("problem is not null")


def roster_problems(roster: DataFrame, key: str, version: str, expected_version: str, expected: int | None = None) -> DataFrame:
    """(problem, value): rows of another version, ids that are repeated or empty, and a count that is not the expected one."""
    out = roster.where(~F.col(version).eqNullSafe(F.lit(expected_version))).select(F.lit("version").alias("problem"), F.col(key).cast("string").alias("value"))
    out = out.union(roster.groupBy(key).count().where("count > 1").select(F.lit("repeated id"), F.col(key).cast("string")))
    out = out.union(roster.where(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == "").select(F.lit("empty id"), F.lit("")))
    if expected is not None:
        out = out.union(roster.agg(F.count("*").alias("n")).where(F.col("n") != expected).select(F.lit("count"), F.col("n").cast("string")))
    return out


def generated_problems(rows: DataFrame, ident: str, text: str, required: tuple[str, ...], expected: int | None = None) -> DataFrame:
    """(problem, value): generated ids or texts that occur twice, required parameters that are empty, and a count that is not the expected one."""
    out = rows.groupBy(ident).count().where("count > 1").select(F.lit("repeated id").alias("problem"), F.col(ident).cast("string").alias("value"))
    out = out.union(rows.groupBy(text).agg(F.count("*").alias("count"), F.min(ident).alias("first")).where("count > 1").select(F.lit("repeated text"), F.col("first").cast("string")))
    for field in required:
        out = out.union(rows.where(F.trim(F.coalesce(F.col(field).cast("string"), F.lit(""))) == "").select(F.lit(f"empty {field}"), F.col(ident).cast("string")))
    if expected is not None:
        out = out.union(rows.agg(F.count("*").alias("n")).where(F.col("n") != expected).select(F.lit("count"), F.col("n").cast("string")))
    return out


def review_rules(text: Column) -> list[tuple[str, Column]]:
    n, new, verdict = F.size("issues"), F.coalesce("safe_replacement", F.lit("")), F.col("verdict")
    return [("verdict", ~verdict.isin("pass", "revise")), ("pass_with_issues", (verdict == "pass") & (n > 0)), ("pass_changes_text", (verdict == "pass") & (new != text)), ("revise_without_issues", (verdict == "revise") & (n == 0)), ("revise_without_text", (verdict == "revise") & (F.trim(new) == ""))]


def manifest_mismatches(manifest: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields in which a manifest differs from what is there (a missing side differs in all)."""
    both = manifest.alias("m").join(actual.alias("a"), key, "full_outer")
    items = [F.struct(F.lit(f).alias("field"), F.col(f"m.{f}").cast("string").alias("stated"), F.col(f"a.{f}").cast("string").alias("found")) for f in fields]
    return both.select(key, F.explode(F.array(*items)).alias("x")).select(key, "x.*").where(~F.col("stated").eqNullSafe(F.col("found")))


def projection_differences(projected: DataFrame, full: DataFrame, key: str) -> DataFrame:
    """Projected fields that are not the full card's."""
    fields = [c for c in projected.columns if c != key]
    return manifest_mismatches(projected.select(key, *fields), full.select(key, *fields), key, fields)


def reusable(inputs: DataFrame, outputs: DataFrame, key: str, valid: Column) -> DataFrame:
    """Inputs that still need work: those without a valid output."""
    return inputs.join(outputs.where(valid).select(key), key, "left_anti")


def nested_keys(rows: DataFrame, key: str, json: str, forbidden: tuple[str, ...]) -> DataFrame:
    """(key, forbidden): the forbidden object keys at any depth of a JSON text, escaped ones too, each once for each key; text that is no JSON has none.

    A recursive query explodes VARIANT objects and arrays level by level; only their nested objects and arrays go on to the next, and of a level
    with forbidden keys just those are kept beside."""
    spark = rows.sparkSession
    wanted = F.array(*map(F.lit, forbidden)).cast("array<string>").alias("wanted")
    docs = rows.select(F.col(key).alias("id"), F.try_parse_json(json).alias("v"), wanted).where("v is not null")
    found = recursive(spark, f"""
        WITH RECURSIVE walk AS (
            SELECT id, wanted, CAST(NULL AS STRING) AS name, v FROM {{docs}}
            UNION ALL
            SELECT w.id, w.wanted, e.key, CASE WHEN {IS_ARRAY.format("e.value")} OR {IS_OBJECT.format("e.value")} THEN e.value END
            FROM walk w, LATERAL variant_explode(w.v) e
            WHERE array_contains(w.wanted, e.key) OR {IS_ARRAY.format("e.value")} OR {IS_OBJECT.format("e.value")})
        SELECT DISTINCT id, name FROM walk WHERE array_contains(wanted, name)""", "nested-keys", docs=docs)
    return found.select(F.col("id").alias(key), F.col("name").alias("forbidden"))


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def first_conflicts(answers: DataFrame, answer: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(answer, rule, card) of the first rule that an answer breaks: rules in order, then the least card."""
    order = F.coalesce(*(F.when(test, F.lit(i)) for i, (_, test) in enumerate(rules)))
    hit = answers.withColumn("_rule", order).where(F.col("_rule").isNotNull())
    best = hit.groupBy(answer).agg(F.min(F.struct("_rule", "card")).alias("b"))
    return best.select(answer, F.element_at(F.array(*(F.lit(n) for n, _ in rules)), F.col("b._rule") + 1).alias("rule"), F.col("b.card").alias("card"))


#: The seven rules on answers, in their order.
ANSWER_RULES = ("missing_contact", "claimed_acquaintance", "claimed_interaction", "missing_disclosure", "exaggerated_familiarity", "wrong_region", "denied_interaction")


def answer_conflicts(pairs: DataFrame, contacts: DataFrame, answer: str, phrases: dict[str, tuple[str, ...]], close: tuple[str, ...], local: tuple[str, ...] = ("local ",)) -> DataFrame:
    """(answer, rule, card): the first rule that an answer breaks, cards in order of their id within a rule's turn.

    pairs: a row for each answer and card that is active in it: answer, card, kind (relationship or character), acquainted,
    familiarity, region, direct (the card holds direct dialogue), user (text), draft (text), user_names (the user names the card),
    aliases (those that stand in the draft) and user_regions (array of structs of region and name, asked for by the user). contacts: a row for each answer, region asked for and card there
    that may be contacted: answer, card, named (the draft names it).

    1 missing_contact: the user asks whom one knows in a region, there are contacts, and the draft names none of a region's.
    2 to 6, card by card in order of id: claims of acquaintance or of an interaction without evidence, no disclosure where the
    user proposes a meeting with a stranger, exaggerated familiarity, a card made local to another region. 7 denied_interaction: a
    character with direct dialogue is said never to have been met."""
    says = lambda name, where="draft": any_of(F.col(where), phrases[name])
    stranger, related = ~F.col("acquainted"), F.col("kind") == "relationship"
    made_local = lambda r, a: F.exists(F.array(F.concat(r["name"], F.lit("的")), *map(F.lit, local)), lambda w: F.contains("draft", F.concat(w, a)))
    wrong = F.exists("user_regions", lambda r: (r["region"] != F.col("region")) & F.exists("aliases", lambda a: made_local(r, a)))
    order = (
        F.when(related & stranger & says("acquaintance"), 2).when(related & stranger & says("interaction"), 3).when(related & stranger & F.col("user_names") & says("proposal", "user") & ~says("disclosure"), 4)
        .when(related & ~F.col("familiarity").isin(*close) & says("familiarity"), 5).when(related & wrong, 6).when((F.col("kind") == "character") & F.col("direct") & says("denial"), 7)
    )
    broken = pairs.select(answer, "card", "kind", order.alias("rule")).where("rule is not null")
    # relationship cards are gone through before characters, each card with its own first rule
    broken = broken.select(answer, F.struct(F.when(F.col("kind") == "relationship", 1).otherwise(2).alias("turn"), "card", "rule").alias("b"))
    asked = contacts.groupBy(answer, "region").agg(F.max("named").alias("named"), F.min("card").alias("card")).where("not named")
    first = broken.union(asked.select(answer, F.struct(F.lit(0).alias("turn"), "card", F.lit(1).alias("rule")))).groupBy(answer).agg(F.min("b").alias("b"))
    return first.select(answer, F.element_at(F.array(*map(F.lit, ANSWER_RULES)), F.col("b.rule")).alias("rule"), F.col("b.card").alias("card"))


def grounded(rows: DataFrame, quote: str, draft: str, card_quote: str, cards: str) -> DataFrame:
    """A reported conflict counts if both quotes stand verbatim where they are said to."""
    ok = (F.length(quote) > 0) & (F.length(card_quote) > 0) & F.contains(F.col(draft), F.col(quote)) & F.contains(F.col(cards), F.col(card_quote))
    return rows.withColumn("grounded", F.coalesce(ok, F.lit(False)))
