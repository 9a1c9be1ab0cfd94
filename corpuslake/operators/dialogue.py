"""Turns of conversations and branching scenes: flattening, context, adjacency, merging, compaction, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslake.functions.text import BLANK
from corpuslake.operators.tables import IS_ARRAY, IS_OBJECT, numbered, recursive, settled

#: Columns of a turn.
TURN = ("scene_path", "scene_id", "objective", "pos", "place", "branch_path", "id", "speaker", "text", "kind", "context_before")
#: Where an item's own responses stand among its choices: after all of them.
AFTER = 1 << 30


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scene_containers(docs: DataFrame, json: str = "json") -> DataFrame:
    """(doc, path, keep, v): every object that owns a list `dialogues`, at any depth; what is inside that list is not looked at, what stands beside it is.

    doc numbers the documents, keep holds their other columns. A recursive query explodes VARIANT objects and arrays, and only those go on."""
    keep = F.struct(*(F.col(c) for c in docs.columns if c != json)) if len(docs.columns) > 1 else F.struct(F.lit(None).cast("string").alias("_none"))
    start = docs.select(F.monotonically_increasing_id().alias("doc"), keep.alias("keep"), F.try_parse_json(F.col(json)).alias("v")).where("v is not null")
    return recursive(docs.sparkSession, f"""
        WITH RECURSIVE walk AS (
            SELECT doc, keep, CAST(array() AS ARRAY<STRING>) AS path, v FROM {{start}}
            UNION ALL
            SELECT w.doc, w.keep, concat(w.path, array(coalesce(e.key, CAST(e.pos AS STRING)))), e.value
            FROM walk w, LATERAL variant_explode(w.v) e
            WHERE ({IS_ARRAY.format("e.value")} AND coalesce(e.key, '') <> 'dialogues') OR {IS_OBJECT.format("e.value")})
        SELECT doc, path, keep, v FROM walk WHERE try_variant_get(v, '$.dialogues', 'array<variant>') IS NOT NULL""", "scenes", start=start)


def flatten_documents(docs: DataFrame, json: str = "json", player: str = "Player", context: int = 0, blank: bool = True, responses: bool = False, speaker: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Turns of all scenes in nested JSON documents of any depth, and the documents that can't be parsed.

    Scene id: the first of id, talkId and initDialog that is neither empty nor 0, else the path. A choice is a turn of the player. blank: turns without
    text are turns too, but one needs a speaker and a text. Otherwise they are left out, and a missing speaker is `speaker`. responses: an
    item's own list `response` is read after its choices. place is the path of (item, choice) positions that lead to the branch a turn stands in;
    ids may repeat or be empty, positions don't. context_before holds up to `context` turns that lead to the turn: a branch goes on from the
    turns before its choice, and what follows the branch does not know it.

    Two recursive queries over VARIANT: scene_containers(), and one that opens a scene's sequences of items: each choice with its
    response makes another sequence, with the context that leads to it. A turn's key is the path of positions down to it, so arrays of positions
    in their natural order are the depth-first order. Contexts are slices of a sequence's own array; no scene is gathered."""
    if context < 0:
        raise ValueError("context must not be negative")
    of = lambda v, field, kind="string": f"try_variant_get({v}, '$.{field}', '{kind}')"
    blanks = lambda v: f"regexp_replace({v}, {_quoted(f'^{BLANK}+|{BLANK}+$')}, '')"
    spoken = lambda v: f"coalesce(schema_of_variant({of(v, 'text', 'variant')}) = 'STRING' AND {blanks(of(v, 'text'))} <> '', false)"
    there = lambda v: f"({IS_OBJECT.format(v)} AND {of(v, 'speaker', 'variant')} IS NOT NULL AND {of(v, 'text', 'variant')} IS NOT NULL)" if blank else f"({IS_OBJECT.format(v)} AND {spoken(v)})"
    body = lambda v: f"coalesce({of(v, 'text')}, '')" if blank else blanks(of(v, "text"))
    turn = lambda v, who, kind: f"named_struct('id', coalesce({of(v, 'id')}, ''), 'speaker', {who}, 'text', {body(v)}, 'kind', '{kind}')"
    said = lambda v: turn(v, f"coalesce(nullif({of(v, 'speaker')}, ''), {_quoted(speaker or '')})", "dialogue")
    newest = lambda turns: f"slice({turns}, greatest(1, size({turns}) - {context - 1}), {context})" if context else f"slice({turns}, 1, 0)"
    chosen = f"CASE WHEN {'true' if blank else spoken('c')} THEN {turn('c', _quoted(player), 'choice')} END"
    no_items = "CAST(array() AS ARRAY<VARIANT>)"
    branches = f"filter(transform(coalesce({of('item', 'choices', 'array<variant>')}, {no_items}), (c, n) -> CASE WHEN {IS_OBJECT.format('c')} THEN named_struct('n', n, 'own', false, 'branch', coalesce({of('c', 'id')}, ''), 'head', {chosen}, 'items', coalesce({of('c', 'response', 'array<variant>')}, {no_items})) END), b -> b IS NOT NULL)"
    if responses:
        empty = f"named_struct('n', {AFTER}, 'own', true, 'branch', '', 'head', CAST(NULL AS STRUCT<id: STRING, speaker: STRING, text: STRING, kind: STRING>), 'items', coalesce({of('item', 'response', 'array<variant>')}, {no_items}))"
        branches = f"concat({branches}, array({empty}))"
    up_to = f"transform(filter(slice(items, 1, i + 1), x -> {there('x')}), x -> {said('x')})"
    led = "concat(led, CASE WHEN head IS NULL THEN slice(led, 1, 0) ELSE array(head) END)"

    found = scene_containers(docs, json)
    names = [F.nullif(F.nullif(F.nullif(F.expr(of("v", k)), F.lit("")), F.lit("0")), F.lit("false")) for k in ("id", "talkId", "initDialog")]
    none = "CAST(array() AS ARRAY<STRUCT<id: STRING, speaker: STRING, text: STRING, kind: STRING>>)"
    start = found.select("doc", "keep", "path", F.coalesce(*names, F.array_join("path", "/")).alias("scene_id"), F.expr(f"coalesce({of('v', 'objective')}, '')").alias("objective"), F.expr(of("v", "dialogues", "array<variant>")).alias("items"))
    sequences = recursive(docs.sparkSession, f"""
        WITH RECURSIVE opened AS (
            SELECT doc, keep, path, scene_id, objective, CAST(array() AS ARRAY<INT>) AS key, CAST(array() AS ARRAY<INT>) AS place, CAST(array() AS ARRAY<STRING>) AS branch,
                   CAST(NULL AS STRUCT<id: STRING, speaker: STRING, text: STRING, kind: STRING>) AS head, {none} AS led, items FROM {{start}}
            UNION ALL
            SELECT doc, keep, path, scene_id, objective, concat(key, array(i, b.n)), CASE WHEN b.own THEN place ELSE concat(place, array(i, b.n)) END, CASE WHEN b.own THEN branch ELSE concat(branch, array(b.branch)) END,
                   b.head, {newest(f"concat({led}, {up_to})")}, b.items
            FROM opened LATERAL VIEW posexplode(items) AS i, item LATERAL VIEW explode({branches}) AS b)
        SELECT * FROM opened""", "sequences", start=start)
    own = sequences.withColumns({
        "at": F.expr(f"filter(transform(items, (x, i) -> CASE WHEN {there('x')} THEN i END), i -> i IS NOT NULL)"), "own": F.expr(f"transform(filter(items, x -> {there('x')}), x -> {said('x')})"),
        "before": F.expr(newest(led)),
    }).withColumn("all", F.concat("before", "own"))
    each = f"transform(own, (t, j) -> named_struct('key', concat(key, array(at[j])), 'turn', t, 'context', slice(all, greatest(1, size(before) + j - {context - 1}), least({context}, size(before) + j))))"
    first = "CASE WHEN head IS NULL THEN slice({0}, 1, 0) ELSE array(named_struct('key', key, 'turn', head, 'context', led)) END"
    turns = own.withColumn("turns", F.expr(each)).select("doc", "keep", "path", "scene_id", "objective", "place", "branch", F.explode(F.expr(f"concat({first.format('turns')}, turns)")).alias("t"))
    pos = F.row_number().over(W.partitionBy("doc", "path").orderBy("t.key")) - 1
    kept = [F.col(f"keep.{c}").alias(c) for c in docs.columns if c != json]
    out = turns.select(*kept, F.col("path").alias("scene_path"), "scene_id", "objective", pos.alias("pos"), "place", F.col("branch").alias("branch_path"), "t.turn.*", F.col("t.context").alias("context_before"))
    return out, docs.where(F.try_parse_json(F.col(json)).isNull())


def preceding_context(docs: DataFrame, target: Column, size: int = 8, **how) -> DataFrame:
    """Target turns of nested documents with up to `size` turns that lead to them."""
    if size < 1:
        raise ValueError("size must be 1 or more")
    return flatten_documents(docs, context=size, **how)[0].where(target)


def rolling_context(turns: DataFrame, scene: str, order: str, fields: list[str], size: int = 8) -> DataFrame:
    """The same for conversations without branches."""
    return turns.withColumn("context_before", F.collect_list(F.struct(*fields)).over(W.partitionBy(scene).orderBy(order).rowsBetween(-size, -1)))


def adjacent(turns: DataFrame, scene: str, order: str, speaker: str, ego: str, branch: str | None = None) -> DataFrame:
    """Neighbouring turns of one branch of which exactly one is the ego's: scene, order, other (speaker) and whether the ego is first."""
    w = W.partitionBy(scene).orderBy(order)
    nxt = turns.withColumns({"next_speaker": F.lead(speaker).over(w), "same_branch": F.lit(True) if branch is None else F.col(branch) == F.lead(branch).over(w)})
    first, second = F.col(speaker) == ego, F.col("next_speaker") == ego
    return nxt.where(F.col("next_speaker").isNotNull() & F.col("same_branch") & (first != second)).select(scene, order, F.when(first, F.col("next_speaker")).otherwise(F.col(speaker)).alias("other"), first.alias("ego_first"))


def merged_runs(rows: DataFrame, by: str, order: list[str], same: str, text: str) -> DataFrame:
    """Runs of equal neighbours (gaps and islands): by, run number, same, first and last order value, number and joined texts (blank ones dropped)."""
    w = W.partitionBy(by).orderBy(*order)
    new = (F.lag(same).over(w).isNull() | (F.lag(same).over(w) != F.col(same))).cast("int")
    runs = rows.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    item = F.struct(*order, F.col(text).alias("text"))
    texts = F.filter(F.transform(F.array_sort(F.collect_list(item)), lambda s: F.trim(s["text"])), lambda t: t != "")
    return runs.groupBy(by, "run", same).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"), F.array_join(texts, "\n").alias("text"))


def merged_chains(rows: DataFrame, node: str, before: str, group: str, text: str) -> DataFrame:
    """Lines that continue their predecessor of the same group, where it has no other successor, joined in order.

    Heads are found by pointer doubling with a written table a round; rows of a cycle, which no head reaches, stay alone.
    Returns head, merged ids in order and the joined text (blank ones dropped)."""
    prev = rows.select(F.col(node).alias("p"), F.col(group).alias("pg"))
    edge = rows.join(prev, (F.col(before) == F.col("p")) & (F.col(group) == F.col("pg"))).select(F.col(node).alias("n"), "p")
    only = edge.groupBy("p").agg(F.count("*").alias("c"), F.min("n").alias("n")).where("c = 1").select("n", "p")
    jump = settled(rows.select(F.col(node).alias("n")).join(only, "n", "left").select("n", F.coalesce("p", "n").alias("up"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("p").isNull().alias("done")), "chain")
    total = rows.count()
    for _ in range(max(1, total.bit_length()) + 1):
        if not jump.where("not done").limit(1).count():
            break
        up = jump.select(F.col("n").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("more"), F.col("done").alias("top"))
        jump = settled(jump.join(up, "up").select("n", F.when(F.col("done"), F.col("up")).otherwise(F.col("up2")).alias("up"), F.when(F.col("done"), F.col("steps")).otherwise(F.col("steps") + F.col("more")).alias("steps"), (F.col("done") | F.col("top")).alias("done")), "chain")
    placed = rows.join(jump.select(F.col("n").alias(node), F.when(F.col("done"), F.col("up")).otherwise(F.col("n")).alias("head"), F.when(F.col("done"), F.col("steps")).otherwise(0).alias("at")), node)
    items = F.array_sort(F.collect_list(F.struct("at", F.col(node).alias("id"), F.trim(text).alias("text"))))
    out = placed.groupBy("head").agg(items.alias("items"))
    return out.select("head", F.transform("items", lambda s: s["id"]).alias("merged_ids"), F.array_join(F.filter(F.transform("items", lambda s: s["text"]), lambda t: F.coalesce(t, F.lit("")) != ""), "\n").alias("text"))


def persistent(turns: DataFrame, role: str = "role", text: str = "text", summary_prefix: str = "[summary]") -> DataFrame:
    """System messages go, summaries stay."""
    return turns.where((F.col(role) != "system") | F.startswith(text, F.lit(summary_prefix)))


def compaction_split(turns: DataFrame, session: str, order: str, role: str, keep: int = 4, least: int = 3) -> DataFrame:
    """Turns with compacted: true for those to be summarised. The newest `keep` stay, one more if the last is the user's, but at most all but one;
    and one more if the first that stays answers a user turn. A leading system turn is no part of the history; histories under
    `least` turns stay whole."""
    w = W.partitionBy(session)
    back = w.orderBy(F.desc(order))
    numbered = turns.withColumns({"n": F.count("*").over(w), "back": F.row_number().over(back), "last_role": F.first(role).over(back)})
    leads = F.coalesce(F.max(F.when(F.col("back") == F.col("n"), F.col(role) == "system")).over(w), F.lit(False))
    numbered = numbered.withColumn("leads", leads).withColumn("n", F.col("n") - F.col("leads").cast("int"))
    pulled = numbered.withColumn("kept", F.least(F.col("n") - 1, F.lit(keep) + F.coalesce(F.col("last_role") == "user", F.lit(False)).cast("int")))
    at = lambda place: F.max(F.when(F.col("back") == place, F.col(role))).over(w)
    answers = (at(F.col("kept")) == "assistant") & (at(F.col("kept") + 1) == "user")
    stay = F.col("kept") + F.coalesce(answers, F.lit(False)).cast("int")
    return pulled.withColumn("compacted", (F.col("n") >= least) & (F.col("back") > stay) & (F.col("back") <= F.col("n"))).drop("n", "back", "last_role", "leads", "kept")


def speaker_inventory(turns: DataFrame, scene: str, order: str, speaker: str, ego: str, other_name: str, branch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Each speaker's scenes, lines, lines next to one of the ego's, and commonest name in the other language (the first met of equally common ones,
    by scene and order; '' for none); and each speaker's scenes in long form with their place (from 1) in order of the scene.

    The mode is exact: lines are counted by speaker and name first, and a speaker's row is picked from those counts, so a speaker of a third of
    all lines sends one row for each name and task. Turns without a speaker do not count. Scenes are placed by a range partitioning, as
    a speaker may have any number of them."""
    spoken = turns.where(F.coalesce(speaker, F.lit("")) != "")
    near = adjacent(turns, scene, order, speaker, ego, branch).groupBy(F.col("other").alias(speaker)).agg(F.count("*").alias("adjacent"))
    names = spoken.groupBy(speaker, F.coalesce(other_name, F.lit("")).alias("name")).agg(F.count("*").alias("n"), F.min(F.struct(scene, order)).alias("first"))
    named = names.groupBy(speaker).agg(F.sum("n").alias("lines"), F.min_by(F.when(F.col("name") != "", F.col("name")), F.when(F.col("name") != "", F.struct(-F.col("n"), "first"))).alias("other_name"))
    pairs = spoken.select(speaker, scene).distinct()
    own = pairs.groupBy(speaker).agg(F.count("*").alias("scenes")).join(named, speaker).join(near, speaker, "left")
    placed = numbered(pairs, [F.col(speaker), F.col(scene)], "place")
    first = placed.groupBy(speaker).agg(F.min("place").alias("first"))
    listed = placed.join(first, speaker).select(speaker, scene, (F.col("place") - F.col("first") + 1).alias("place"))
    return own.select(speaker, "scenes", "lines", F.coalesce("adjacent", F.lit(0)).alias("adjacent"), F.coalesce("other_name", F.lit("")).alias("other_name")), listed


def session_titles(turns: DataFrame, session: str, order: str, role: str = "role", text: str = "text", most: int = 60, default: str = "untitled") -> DataFrame:
    """The first user message, line ends as spaces, cut; a default for sessions without one."""
    first = F.min_by(F.when(F.col(role) == "user", F.col(text)), F.when(F.col(role) == "user", F.col(order)))
    return turns.groupBy(session).agg(F.coalesce(F.substring(F.trim(F.regexp_replace(first, "[\r\n]+", " ")), 1, most), F.lit(default)).alias("title"))
