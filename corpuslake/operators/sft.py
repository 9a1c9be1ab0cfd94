"""Training rows: prompts, assembly, token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.text import compact_title


def sft_rows(rows: DataFrame, system: str, prompt: Column, completion: Column, group: Column, language: Column, **metadata: Column) -> DataFrame:
    """id, language, group_id, prompt [system, user], completion (assistant) and metadata."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    ident = F.sha2(F.concat_ws("\x00", group, prompt, completion), 256)
    return rows.select(ident.alias("id"), language.alias("language"), group.alias("group_id"), F.array(message("system", F.lit(system)), message("user", prompt)).alias("prompt"), message("assistant", completion).alias("completion"), F.struct(*(c.alias(k) for k, c in metadata.items())).alias("metadata"))


#: Objectives that say nothing (fixed values).
NO_OBJECTIVE = ("additional", "none", "null")


def scene_prompt(title: Column, objective: Column, context: Column, words: dict[str, str], rename: dict[str, str], single_last: bool = False) -> Column:
    """What a line answers to: headed blocks of title, objective and the lines before it. An objective that repeats the title or says nothing is left out.

    words: scene, situation, previous, last, choice (what stands for the speaker of a choice), someone, colon, fallback and close. With single_last
    the last line stands under its own heading, choices are the player's, and a scene without any line is an error; otherwise the fallback stands for the lines."""
    named = lambda s: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in (rename or {"": ""}).items() for x in kv]), s), s)
    who = lambda t: F.when(t["kind"] == "choice", F.lit(words["choice"])).otherwise(named(F.coalesce(F.nullif(t["speaker"], F.lit("")), F.lit(words["someone"]))))
    lines = F.transform(F.filter(context, lambda t: F.trim(F.coalesce(t["text"], F.lit(""))) != ""), lambda t: F.concat(who(t), F.lit(words["colon"]), t["text"]))
    title, objective = F.coalesce(title, F.lit("")), F.coalesce(objective, F.lit(""))
    head = [F.when(title != "", F.concat(F.lit(words["scene"]), title)), F.when((objective != "") & (objective != title) & ~F.lower(objective).isin(*NO_OBJECTIVE), F.concat(F.lit(words["situation"]), objective))]
    block = lambda xs: F.when(F.size(xs) > 0, F.concat(F.lit(words["previous"] + "\n"), F.array_join(xs, "\n")))
    if not single_last:
        return F.concat_ws("\n", *head, F.coalesce(block(lines), F.lit(words["fallback"])), F.lit(words["close"]))
    last = F.when(F.size(lines) > 0, F.get(lines, F.size(lines) - 1)).otherwise(F.raise_error(F.lit("a scene row without usable context")))
    return F.concat_ws("\n", *head, block(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))), F.lit(words["last"]), last, F.lit(words["close"]))


def line_prompt(title: Column, category: Column, group: Column, exact: dict[str, str], topic: tuple[str, str, str], by_category: dict[str, str], combat: str, otherwise: str) -> Column:
    """The prompt of a line that has no context, from its title: an exact text, else by rule, first hit first.

    topic: a prefix, a separator and a form for what stands behind it; by_category: category -> form; combat: the form of that
    group; otherwise: the form of all others. A form holds %s for the title, or none. One table of rules a language."""
    short = compact_title(F.coalesce(title, F.lit("")))
    form = lambda f, x: F.concat(*[p for i, t in enumerate(f.split("%s")) for p in ([x] if i else []) + [F.lit(t)]])
    prefix, mark, about = topic
    out = F.when(F.coalesce(group == "combat", F.lit(False)), form(combat, short)).otherwise(form(otherwise, short))
    for name, f in reversed(list(by_category.items())):
        out = F.when(F.coalesce(category == name, F.lit(False)), form(f, short)).otherwise(out)
    behind = F.trim(F.substr(short, F.instr(short, F.lit(mark)) + F.lit(len(mark))))
    out = F.when(F.startswith(short, F.lit(prefix)) & F.contains(short, F.lit(mark)), form(about, behind)).otherwise(out)
    fixed = F.try_element_at(F.create_map(*[F.lit(x) for kv in (exact or {"": ""}).items() for x in kv]), short)
    return F.coalesce(fixed, out)


def packed(rows: DataFrame, system: str, user: str, completion: str, budget: int) -> DataFrame:
    """Token arrays within a budget: the system prompt stays, the completion is cut at what is left, then the latest user tokens
    fit in. input_ids, labels (-100 on the prompt) and what was cut."""
    s, u, c = F.col(system), F.col(user), F.col(completion)
    room = F.greatest(F.lit(budget) - F.size(s), F.lit(0))
    kept = F.slice(c, 1, room)
    left = F.greatest(room - F.size(kept), F.lit(0))
    tail = F.when(left >= F.size(u), u).when(left == 0, F.array().cast("array<int>")).otherwise(F.slice(u, -left, left))
    return rows.withColumns({"kept": kept, "tail": tail}).select("*", F.concat(s, "tail", "kept").alias("input_ids"), F.concat(F.array_repeat(F.lit(-100), F.size(s) + F.size("tail")), "kept").alias("labels"), (F.size(u) - F.size("tail")).alias("user_cut"), (F.size(c) - F.size("kept")).alias("completion_cut")).drop("kept", "tail")
