"""Scene and line projections: flags, predicates, exclusions over both languages, compact sides, voice rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import text as T
from corpuslake.functions.text import BLANK, clean_markup
from corpuslake.operators.quality import all_reasons

#: Names of the flags (fixed values).
FLAGS = ("joint_speaker", "contains_markup", "contains_hidden_marker", "text_test_marker", "metadata_test_marker", "discarded_marker", "empty_text")


def line_flags(speaker: Column, text: Column, target: Column, metadata: Column, test: str = "(test)", hidden: str = "$hidden", discarded: str = "discarded") -> Column:
    """A struct of the seven flags of a line; metadata is an array of the strings around it."""
    low, some = F.lower(text), F.transform(metadata, F.lower)
    values = {
        "joint_speaker": F.contains(speaker, target) & (F.trim(speaker) != target), "contains_markup": text.rlike(r"\{[^}]+\}|<[^>]+>|(?m)^#"), "contains_hidden_marker": F.contains(low, F.lit(hidden)) | F.exists(some, lambda m: F.contains(m, F.lit(hidden))),
        "text_test_marker": F.contains(low, F.lit(test)), "metadata_test_marker": F.exists(some, lambda m: F.contains(m, F.lit(test))), "discarded_marker": F.exists(some, lambda m: F.contains(m, F.lit(discarded))),
        "empty_text": F.regexp_replace(text, BLANK, "") == "",
    }
    return F.struct(*(F.coalesce(values[f], F.lit(False)).alias(f) for f in FLAGS))


def scene_flags(objective: Column, turns: Column, metadata: Column, hidden: str = "$hidden", test: str = "(test)") -> Column:
    """A struct of a whole scene's flags: hidden (its objective, a string around it or any turn says so) and test, likewise."""
    said = F.concat(F.array(F.coalesce(objective, F.lit(""))), F.coalesce(metadata, F.array().cast("array<string>")), F.transform(turns, lambda t: F.coalesce(t["text"], F.lit(""))))
    marked = lambda mark: F.exists(said, lambda x: F.contains(F.lower(F.coalesce(x, F.lit(""))), F.lit(mark)))
    return F.struct(marked(hidden).alias("hidden"), marked(test).alias("test"))


def compact_side(fields: dict[str, Column], flags: Column | None = None) -> Column:
    """One side of a parallel pair: its fields by their short names and the names of the flags that are set; null where the side has no id."""
    own = [c.alias(name) for name, c in fields.items()]
    if flags is not None:
        own.append(F.array_compact(F.array(*(F.when(flags[f], F.lit(f)) for f in FLAGS))).alias("flags"))
    return F.when(next(iter(fields.values())).isNotNull(), F.struct(*own))


def without(rows: DataFrame, *fields: str) -> DataFrame:
    """Rows as they are compared: without the fields that may differ."""
    return rows.drop(*fields)


def usable_objective(objective: Column, markers: tuple[str, ...] = ("$hidden", "(test)", "discarded")) -> Column:
    out = F.lit(True)
    for m in markers:
        out = out & ~F.contains(F.lower(F.coalesce(objective, F.lit(""))), F.lit(m))
    return out


def speaker_is(speaker: Column, names: Column, mode: str = "contains") -> Column:
    """contains: a name stands in the speaker; folded: equal or contained whatever the case; bracketed: the name, alone or before a bracket."""
    if mode == "contains":
        return F.exists(names, lambda n: F.contains(speaker, n))
    if mode == "folded":
        return F.exists(names, lambda n: F.contains(F.lower(speaker), F.lower(n)))
    return F.exists(names, lambda n: (speaker == n) | F.startswith(speaker, F.concat(n, F.lit("("))) | F.startswith(speaker, F.concat(n, F.lit("（"))))


def with_target(scenes: DataFrame, turns: str, target: Column) -> DataFrame:
    return scenes.where(F.exists(turns, lambda t: F.contains(t["speaker"], target)))


def pair_exclusions(left: Column, right: Column, strict: bool = False) -> Column:
    """All flags that either side sets and that keep a pair out of training; strict adds the metadata's test marker."""
    names = ["text_test_marker", "discarded_marker", "empty_text", "joint_speaker"] + ["metadata_test_marker"] * strict
    return all_reasons([(n, F.coalesce(left[n], F.lit(False)) | F.coalesce(right[n], F.lit(False))) for n in names])


def chat_rules(text: Column, context: Column, ego: str, narrator: str, fillers: tuple[str, ...], starts: tuple[str, ...], voice: Column | None = None, combat: Column | None = None, mismatch: Column | None = None) -> list[tuple[str, Column]]:
    """Why a line is left out of direct chat, in the order of the rules; quality.first_reason() takes the first that holds.

    Voice lines have no context and are left out if they are combat ones. Any other line needs turns before it (context: an array of speaker,
    text and kind, oldest first), of which the last must be neither the ego's own nor narration, must mean something, and must be no choice
    in brackets; mismatch marks lines known not to answer it. After that the text itself counts. voice, combat and mismatch default to false."""
    no = F.lit(False)
    voice, combat, mismatch = (F.coalesce(c, no) if c is not None else no for c in (voice, combat, mismatch))
    last = F.try_element_at(context, F.lit(-1))
    said = lambda field: F.coalesce(last[field], F.lit(""))
    before = [
        ("scene_without_context", F.coalesce(F.size(context), F.lit(0)) <= 0), ("unmerged_own_turn", said("speaker") == ego), ("narration_transition", said("speaker") == narrator),
        ("nonsemantic_last_utterance", T.semantic_length(said("text")) < 2), ("traveler_internal_monologue", (said("kind") == "choice") & T.parenthesised(said("text"))), ("known_semantic_mismatch", mismatch),
    ]
    own = [("filler_only", T.is_filler(text, fillers)), ("too_short", T.semantic_length(text) < 10), ("fragment_ending", T.fragment_ending(text)), ("leading_ellipsis", T.leading_ellipsis(text)), ("filler_start", T.starts_with_filler(text, starts))]
    return [("combat_voice", voice & combat), *((name, ~voice & test) for name, test in before), *own]


def only_present(rows: DataFrame, fields: list[str]) -> DataFrame:
    return rows.select(*(f for f in fields if f in rows.columns))


def source_strings(rows: DataFrame, key: str, completion: str = "text", context: str = "context_before") -> DataFrame:
    """(key, location, value) of every text of a row."""
    items = F.concat(F.array(F.struct(F.lit("completion").alias("location"), F.col(completion).alias("value"))), F.transform(context, lambda t, i: F.struct(F.concat(F.lit("context_"), i).alias("location"), t["text"].alias("value"))))
    return rows.select(key, F.explode(items).alias("x")).select(key, "x.*")


Rule = tuple[str, tuple[str, ...], str]


def categorise(title: Column, combat: dict[str, str], rules: list[Rule], neutral: tuple[str, ...], other: str = "other_profile") -> Column:
    """(group, category, affinity) of a line's title. combat: prefix -> category of that group, before all others, never affine. rules, in
    order: ("prefix", (...), category) or ("set", (...), category) for the whole title; the first that holds counts, else `other`.
    A profile line is affine unless its category is neutral."""
    found = F.lit(other)
    for kind, values, category in reversed(rules):
        test = title.isin(*values) if kind == "set" else F.exists(F.array(*map(F.lit, values)), lambda v: F.startswith(title, v))
        found = F.when(test, F.lit(category)).otherwise(found)
    out = F.struct(F.lit("profile").alias("voice_group"), found.alias("voice_category"), (~found.isin(*neutral)).alias("affinity"))
    for prefix, category in reversed(list(combat.items())):
        out = F.when(F.startswith(title, F.lit(prefix)), F.struct(F.lit("combat").alias("voice_group"), F.lit(category).alias("voice_category"), F.lit(False).alias("affinity"))).otherwise(out)
    return out


def voice_rows(blocks: DataFrame, parameters: str, index: str, prefix: str, language: str, category: Callable[[Column], Column], license: str) -> DataFrame:
    """Uniform rows from template parameters (title, text, file): ids by document order, cleaned text, category."""
    p = F.col(parameters)
    title = F.coalesce(p["title"], F.lit(""))
    return blocks.select("*", F.concat(F.lit(f"{prefix}_"), F.lpad((F.col(index) + 1).cast("string"), 3, "0")).alias("dialogue_id"), F.lit(language).alias("language"), title.alias("voice_title"), p["text"].alias("raw_text"), clean_markup(p["text"]).alias("text"), F.coalesce(p["file"], F.lit("")).alias("voice_file"), category(title).alias("c"), F.lit(license).alias("source_license")).select("*", "c.*").drop("c", parameters)


def search_text(title: Column, objective: Column, turns: Column) -> Column:
    """What is searched of a scene: title, objective and `speaker：text` lines."""
    return F.array_join(F.concat(F.array(F.coalesce(title, F.lit("")), F.coalesce(objective, F.lit(""))), F.transform(turns, lambda t: F.concat(t["speaker"], F.lit("："), t["text"]))), "\n")


def roster(nodes: DataFrame, field: str, columns: list[str], key: str) -> DataFrame:
    return nodes.select(F.explode(field).alias("n")).select(*(f"n.{c}" for c in columns)).orderBy(key)
