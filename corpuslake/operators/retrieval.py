"""Evidence retrieval: alias matches, lexical scores, windows around matches."""

from __future__ import annotations

import re
from collections.abc import Callable

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslake.functions.text import count_of
from corpuslake.operators.tables import settled


def word_terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def word_matches(texts: DataFrame, text_id: str, text: str, aliases: DataFrame, entity: str, alias: str) -> DataFrame:
    """(text_id, entity, alias, n): aliases of one or more words that stand in a text as whole words, whatever stands between them.

    An equi-join on the alias's first word instead of a theta join: a text's words are exploded once and each position meets the
    aliases that start with its word; the rest is compared there. It holds for gazetteers of any size; Spark broadcasts small ones."""
    terms = aliases.withColumn("_words", word_terms(F.col(alias))).where(F.size("_words") > 0)
    terms = terms.select(entity, alias, "_words", F.get("_words", F.lit(0)).alias("_first"), F.size("_words").alias("_n"))
    widest = terms.agg(F.max("_n")).first()[0] or 1
    spots = texts.select(text_id, word_terms(F.col(text)).alias("_all")).select(text_id, "_all", F.posexplode("_all").alias("_pos", "_first"))
    spots = spots.select(text_id, "_first", F.slice("_all", F.col("_pos") + 1, widest).alias("_here"))
    found = spots.join(terms, (spots["_first"] == terms["_first"]) & (F.slice("_here", 1, F.col("_n")) == F.col("_words")))
    return found.groupBy(text_id, entity, alias).agg(F.count("*").alias("n"))


#: For each rule: which aliases need free neighbours, and what a free neighbour is not.
RULES = {"pipeline": (r"^(?=.*[A-Za-z])[A-Za-z ]+$", "a-z"), "runtime": (r"^[\x00-\x7F]+$", "a-z0-9_")}


def literal(text: Column) -> Column:
    """A pattern that matches the text itself."""
    return F.regexp_replace(text, r"([\\\[\]{}()*+?.^$|&~#-])", r"\\$1")


#: Aliases (and their characters) that one automaton holds; above either, texts and aliases meet by a join.
AUTOMATON_ALIASES, AUTOMATON_CHARS = 200_000, 4_000_000


def _automaton(spark: SparkSession, terms: DataFrame, inner: str) -> Callable[[Column, Column], Column] | None:
    """A function from a text (folded, and as it is) to all aliases in it: an array of _alias, _bound and n, their counts, none overlapping.

    terms: _alias, _bound and _cased (it is looked for in the text as it is). Each text is walked once, whatever the number of aliases. None
    where they are not proven to be few: then they are not brought together in one place."""
    rows = terms.select("_alias", "_bound", "_cased").distinct().limit(AUTOMATON_ALIASES + 1).collect()
    if len(rows) > AUTOMATON_ALIASES or sum(len(r._alias) for r in rows) > AUTOMATON_CHARS:
        return None
    shared, built = spark.sparkContext.broadcast([tuple(r) for r in rows]), []
    beside = re.compile(f"[{inner}]" if inner else "(?!)")

    def build() -> list:
        """One automaton for folded texts and one for texts as they are; a word may be an alias with and without bounds."""
        for cased in (False, True):
            kinds: dict[str, list[bool]] = {}
            for alias, bound, own in shared.value:
                if own == cased and alias:
                    kinds.setdefault(alias, []).append(bound)
            machine = ahocorasick.Automaton()
            for alias, bounds in kinds.items():
                machine.add_word(alias, (alias, bounds))
            machine.make_automaton()
            built.append(machine if kinds else None)
        return built

    def walk(machine: ahocorasick.Automaton | None, text: str | None) -> dict[tuple[str, bool], int]:
        count: dict[tuple[str, bool], int] = {}
        ends: dict[tuple[str, bool], int] = {}
        for last, (alias, bounds) in machine.iter(text) if machine is not None and text else ():
            start, end = last + 1 - len(alias), last + 1
            for bound in bounds:
                taken = bound and (start and beside.match(text[start - 1]) or beside.match(text, end))
                if not taken and start >= ends.get((alias, bound), 0):
                    count[alias, bound], ends[alias, bound] = count.get((alias, bound), 0) + 1, end
        return count

    @F.pandas_udf("array<struct<_alias: string, _bound: boolean, n: bigint>>")
    def found(folded: pd.Series, plain: pd.Series) -> pd.Series:
        machines = built or build()
        return pd.Series([[{"_alias": a, "_bound": b, "n": n} for machine, text in zip(machines, both, strict=True) for (a, b), n in walk(machine, text).items()] for both in zip(folded, plain, strict=True)], dtype=object)

    return found


def _alias_terms(aliases: DataFrame, entity: str, alias: str, mode: str) -> DataFrame:
    """entity, alias, _bound (its neighbours count), _alias (as it is looked for) and _cased (in the text as it is, not folded)."""
    bound = F.col(alias).rlike(RULES[mode][0])
    cased = F.lit(False) if mode == "pipeline" else ~bound
    terms = aliases.where(F.length(alias) >= (2 if mode == "pipeline" else 1)).select(entity, alias, bound.alias("_bound"), F.when(cased, F.col(alias)).otherwise(F.lower(alias)).alias("_alias"), cased.alias("_cased"))
    return terms.distinct()


def alias_matches(texts: DataFrame, text_id: str, text: str, aliases: DataFrame, entity: str, alias: str, mode: str = "pipeline") -> DataFrame:
    """(text_id, entity, alias, n): aliases that a text names, and how often, none overlapping. text_id is unique.

    pipeline: two characters or more; ASCII letters and blanks with no letter beside them; any other as a plain substring, so names
    inside Chinese sentences are found; case is ignored. runtime: ASCII with no word character beside it and without case; any
    other as a plain substring with case.

    Up to AUTOMATON_ALIASES aliases make one automaton, which every task gets and walks each of its texts with once; no text is
    shuffled, and only the aliases found go on. More aliases than that are joined: a bounded alias on its first run of word characters, which
    must be a whole run of the text, any other on its first two characters; a text sends each of its runs and pairs once, without
    itself, and only the pairs of text and alias that are left fetch the text."""
    terms = _alias_terms(aliases, entity, alias, mode)
    find = _automaton(texts.sparkSession, terms, RULES[mode][1])
    if find is not None:
        met = texts.select(text_id, F.explode(find(F.lower(text), F.col(text))).alias("_m")).select(text_id, "_m.*")
        return met.join(terms, ["_alias", "_bound"]).select(text_id, entity, alias, "n")
    terms, keys, chars, found = _alias_keys(text, terms, mode)
    spots = texts.select(text_id, F.col(text), *chars).select(text_id, F.explode(F.array_distinct(F.concat(*keys))).alias("_key"))
    near = spots.join(terms, "_key").drop("_key").distinct().join(texts.select(text_id, F.col(text).alias("_text")), text_id)
    return near.select(text_id, entity, alias, found.alias("n")).where("n > 0")


def _alias_keys(text: str, terms: DataFrame, mode: str) -> tuple[DataFrame, list[Column], list[Column], Column]:
    """Terms with the key that each joins on, a text's keys (over the columns `_chars`, if there are any), and how often an alias stands in `_text`."""
    inner = RULES[mode][1]
    run = F.when(F.col("_bound"), F.nullif(F.regexp_extract("_alias", f"([{inner}]+)", 1), F.lit("")))
    # an ASCII alias without a word character has no run and no case
    terms = terms.withColumn("_key", F.coalesce(F.concat(F.lit("r"), run), F.concat(F.lit("p"), F.substring("_alias", 1, 2))))
    low = F.lower(text)
    keys, chars = [F.transform(F.regexp_extract_all(low, F.lit(f"([{inner}]+)"), F.lit(1)), lambda r: F.concat(F.lit("r"), r))], []
    if not terms.where(F.startswith("_key", F.lit("p"))).isEmpty():
        chars = [F.regexp_extract_all(low if mode == "pipeline" else F.col(text), F.lit("(?s)."), F.lit(0)).alias("_chars")]
        keys += [F.transform("_chars", lambda c, i: F.concat(F.lit("p"), c, F.coalesce(F.get("_chars", i + 1), F.lit("")))), F.transform("_chars", lambda c: F.concat(F.lit("p"), c))]
    free = F.concat(F.lit(f"(?<![{inner}])"), literal(F.col("_alias")), F.lit(f"(?![{inner}])"))
    plain = F.when(F.col("_cased"), F.col("_text")).otherwise(F.lower("_text"))
    n = F.when(F.col("_bound"), F.size(F.regexp_extract_all(F.lower("_text"), free, F.lit(0)))).otherwise(count_of(plain, F.col("_alias")))
    return terms, keys, chars, n.cast("long")


def alias_stream(turns: DataFrame, text: str, aliases: DataFrame, entity: str, alias: str, mode: str = "runtime") -> DataFrame:
    """The same for a stream of turns: a row for each alias that a turn names, one without entity for a turn that names none (or has no text).

    Stateless: each turn is walked once by the automaton, and what it found meets the table of aliases. More aliases than an automaton
    holds are joined by the key that each has, of which a turn sends each once."""
    terms = _alias_terms(aliases, entity, alias, mode)
    find = _automaton(turns.sparkSession, terms, RULES[mode][1])
    if find is not None:
        met = turns.select("*", F.explode_outer(find(F.lower(text), F.col(text))).alias("_m")).select(*turns.columns, "_m._alias", "_m._bound")
        return met.join(terms, ["_alias", "_bound"], "left").select(*turns.columns, entity, alias)
    terms, keys, chars, found = _alias_keys(text, terms, mode)
    spots = turns.select("*", *chars)
    spots = spots.select(*turns.columns, F.explode(F.concat(F.array(F.lit("none")), F.coalesce(F.array_distinct(F.concat(*keys)), F.array().cast("array<string>")))).alias("_key"))
    met = spots.join(terms, "_key", "left").withColumn("_text", F.col(text))
    return met.where((F.col("_key") == "none") | (F.col(entity).isNotNull() & (found > 0))).select(*turns.columns, entity, alias)


def alias_index(aliases: DataFrame, entity: str, alias: str) -> DataFrame:
    """Owners of each alias, sorted, and whether it is ambiguous."""
    owners = aliases.groupBy(F.lower(alias).alias(alias)).agg(F.array_sort(F.collect_set(entity)).alias("owners"))
    return owners.withColumn("ambiguous", F.size("owners") > 1)


def document_frequency(texts: DataFrame, text_id: str, terms: str) -> DataFrame:
    return texts.select(text_id, F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def postings(texts: DataFrame, text_id: str, terms: str) -> DataFrame:
    return texts.select(text_id, F.explode(terms).alias("term")).groupBy(text_id, "term").agg(F.count("*").alias("tf"))


def lexical_scores(queries: DataFrame, query_id: str, texts: DataFrame, text_id: str, terms: str, exact: DataFrame, rarest: int = 80, least: float = 9.0, most_df_share: int = 5, top: int | None = None, blocks: int = 1024) -> DataFrame:
    """(query_id, text_id, score): texts that hold an exact term of the query (exact: query_id, text_id, term_score), scored by
    those and by the rarest terms both share: (ln((N + 1) / (df + 1)) + 1) * (length - 1) * min(counts, 2) * 0.32.

    Both sides are postings (of words or character grams) joined on the term. Terms more frequent than max(8, N / most_df_share) give
    no score, and as rarer ones rank before them, they are cut before anything is joined. Sums run in a fixed order.

    top: only pairs that can be among a query's `top` best are scored to the end, and all those are in the result. What postings of a block of texts
    can add at most is known from the block's largest counts; see promising()."""
    total = texts.count()
    df = document_frequency(texts, text_id, terms).where(F.col("df") <= max(8, total // most_df_share))
    mine, theirs = postings(queries, query_id, terms), postings(texts, text_id, terms)
    wanted = mine.withColumnRenamed("tf", "qf").join(df, "term")
    idf = F.log((F.lit(total + 1.0)) / (F.col("df") + 1)) + 1
    pairs = exact.groupBy(query_id, text_id).agg(F.sum("term_score").alias("base"))
    if top is not None:
        most = theirs.groupBy("term", _block(text_id, blocks).alias("block")).agg(F.max("tf").alias("tf"))
        gains = wanted.join(most, "term").select(query_id, "block", (idf * (F.length("term") - 1) * F.least("qf", "tf", F.lit(2)) * 0.32).alias("gain"))
        pairs = settled(promising(pairs, query_id, text_id, gains, top, least, blocks), "promising")
        theirs = theirs.join(pairs.select(text_id).distinct(), text_id, "left_semi")
    shared = wanted.join(theirs, "term").join(pairs.select(query_id, text_id), [query_id, text_id])
    rank = F.row_number().over(W.partitionBy(query_id, text_id).orderBy("df", F.desc(F.length("term")), "term"))
    top = shared.withColumn("rank", rank).where(F.col("rank") <= rarest)
    gain = idf * (F.length("term") - 1) * F.least("qf", "tf", F.lit(2)) * 0.32
    sums = top.groupBy(query_id, text_id).agg(F.array_sort(F.collect_list(F.struct("rank", gain.alias("gain")))).alias("gains"))
    extra = sums.select(query_id, text_id, F.aggregate("gains", F.lit(0.0), lambda a, x: a + x["gain"]).alias("extra"))
    return pairs.join(extra, [query_id, text_id], "left").select(query_id, text_id, (F.col("base") + F.coalesce("extra", F.lit(0.0))).alias("score")).where(F.col("score") >= least)


def _block(text_id: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(text_id), F.lit(blocks))


def promising(pairs: DataFrame, query_id: str, text_id: str, gains: DataFrame, top: int, least: float, blocks: int) -> DataFrame:
    """Those pairs (query_id, text_id, base) that may be among the `top` best of their query or reach `least`.

    gains: query_id, block and the most that a term can add in that block of texts. A pair ends at base at the worst and at base and all gains of
    its block at best; whoever's best is below the top-th worst of the query is out, and its postings are never read."""
    best = gains.groupBy(query_id, "block").agg(F.sum("gain").alias("most"))
    sure = pairs.withColumn("r", F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("base")))).where(F.col("r") == top).select(query_id, F.col("base").alias("floor"))
    both = pairs.withColumn("block", _block(text_id, blocks)).join(best, [query_id, "block"], "left").join(sure, query_id, "left")
    ceiling = F.col("base") + F.coalesce("most", F.lit(0.0)) + 1e-5
    return both.where((ceiling >= F.coalesce("floor", F.lit(0.0))) & (ceiling >= least)).select(query_id, text_id, "base")


def scene_terms(lines: DataFrame, scene: str, order: str, speaker: str, text: str, ego: str, terms: DataFrame, query_id: str, term: str, head: Column | None = None) -> DataFrame:
    """(query_id, scene, term_score) of each exact term in the search text of a scene, without case, and with what it is worth if the ego says it.

    lines are a scene's lines in order; head is text before them (title and objective). Terms of any script are found, inside words too."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.concat(F.col(speaker), F.lit("："), F.col(text)).alias("line")))), lambda x: x["line"]), "\n")
    scenes = lines.groupBy(scene).agg(body.alias("_body"))
    scenes = scenes if head is None else scenes.withColumn("_body", F.concat_ws("\n", head, "_body"))
    own = terms.select(query_id, F.lower(term).alias("_term")).where(F.length("_term") >= 2).distinct()
    found = substring_matches(scenes, scene, "_body", own, query_id, "_term")
    said = substring_matches(lines.where(F.col(speaker) == ego).select(scene, order, F.concat_ws(":", scene, order).alias("_line"), text), "_line", text, own, query_id, "_term")
    said = said.join(lines.select(F.concat_ws(":", scene, order).alias("_line"), scene), "_line").select(scene, query_id, "_term").distinct().withColumn("_ego", F.lit(True))
    worth = term_score(F.length("_term"), F.col("n"), F.coalesce("_ego", F.lit(False)))
    return found.join(said, [scene, query_id, "_term"], "left").select(query_id, scene, worth.alias("term_score"))


def substring_matches(texts: DataFrame, text_id: str, text: str, terms: DataFrame, entity: str, term: str) -> DataFrame:
    """(text_id, entity, term, n): folded terms of two characters or more anywhere in a text, without case. text_id is unique.

    By the automaton; more terms than it holds are joined on the rarest of their pairs of characters, so that no common pair brings every
    text to a term, and only the texts left are fetched for it."""
    own = terms.select(entity, term, F.col(term).alias("_alias"), F.lit(False).alias("_bound"), F.lit(False).alias("_cased"))
    find = _automaton(texts.sparkSession, own, "")
    if find is not None:
        met = texts.select(text_id, F.explode(find(F.lower(text), F.col(text))).alias("_m")).select(text_id, "_m._alias", "_m.n")
        return met.join(own, "_alias").select(text_id, entity, term, "n")
    pairs = lambda chars: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(chars) - 2), lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1))))
    cut = lambda df, c: df.withColumn("_chars", F.regexp_extract_all(F.lower(c), F.lit("(?s)."), F.lit(0))).where(F.size("_chars") >= 2)
    spots = cut(texts, text).select(text_id, F.explode(pairs(F.col("_chars"))).alias("_key"))
    common = spots.groupBy("_key").agg(F.count("*").alias("_df"))
    keyed = cut(terms.select(entity, term), term).select(entity, term, F.explode(pairs(F.col("_chars"))).alias("_key")).join(common, "_key")
    rarest = keyed.groupBy(entity, term).agg(F.min_by("_key", F.struct("_df", "_key")).alias("_key"))
    near = spots.join(rarest, "_key").select(text_id, entity, term).join(texts.select(text_id, F.lower(text).alias("_text")), text_id)
    return near.select(text_id, entity, term, count_of(F.col("_text"), F.col(term)).cast("long").alias("n")).where("n > 0")


def term_score(length: Column, count: Column, by_ego: Column) -> Column:
    """What an exact term is worth: its length (16 at most), its count (4 at most), and whether the ego says it."""
    return F.lit(18.0) + 3.0 * F.least(length, F.lit(16)) + 4.0 * F.least(count, F.lit(4)) + F.when(by_ego, 24.0).otherwise(0.0)


def top_per_key(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def retained(turns: DataFrame, scene: str, order: str, match: Column, window: int = 8, cap: int = 80, head: int = 0, tail: int = 0) -> DataFrame:
    """Short scenes whole; of longer ones the turns within `window` of a match, and the first head and last tail ones; `cap` at most."""
    w = W.partitionBy(scene).orderBy(order)
    whole = W.partitionBy(scene)
    n, i = F.count("*").over(whole), F.row_number().over(w)
    near = F.max(match.cast("int")).over(w.rowsBetween(-window, window)) == 1
    out = turns.withColumns({"_n": n, "_i": i, "_near": near}).where((F.col("_n") <= cap) | F.col("_near") | (F.col("_i") <= head) | (F.col("_i") > F.col("_n") - tail))
    return out.withColumn("_kept", F.row_number().over(w)).where(F.col("_kept") <= cap).drop("_n", "_i", "_near", "_kept")


def scene_evidence(turns: DataFrame, scene: str, order: str, branch: str, speaker: str, text: str, ego: str, entities: DataFrame, entity: str, alias: str) -> DataFrame:
    """Scores of entities in scenes: 4 for each line the entity speaks, 20 for each line of the ego that names it, 12 for each
    change of speaker between both inside a branch; reasons sorted."""
    w = W.partitionBy(scene).orderBy(order)
    lines = turns.withColumns({"_next": F.lead(speaker).over(w), "_same": F.coalesce(F.lead(branch).over(w) == F.col(branch), F.lit(False))})
    speaks = lines.join(entities, F.lower(speaker) == F.lower(alias)).select(scene, entity, F.lit(4).alias("score"), F.lit("speaks").alias("reason"))
    # only lines of the ego are searched for names
    ego_lines = lines.where(F.col(speaker) == ego).select(scene, order, text).withColumn("_line", F.concat_ws(":", scene, order))
    # by the pipeline's alias rule, so names inside Chinese sentences count
    named = alias_matches(ego_lines, "_line", text, entities, entity, alias).select("_line", entity).distinct()
    names = named.join(ego_lines.select("_line", scene), "_line").select(scene, entity, F.lit(20).alias("score"), F.lit("named").alias("reason"))
    met = lines.where("_same").where((F.col(speaker) == ego) != (F.col("_next") == ego)).select(scene, F.when(F.col(speaker) == ego, F.col("_next")).otherwise(F.col(speaker)).alias("_other"))
    meets = met.join(entities, F.lower("_other") == F.lower(alias)).select(scene, entity, F.lit(12).alias("score"), F.lit("meets").alias("reason"))
    return speaks.union(names).union(meets).groupBy(scene, entity).agg(F.sum("score").alias("score"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def entity_stats(matches: DataFrame, entity: str, scene: str, line: str, adjacent: DataFrame) -> DataFrame:
    """For each entity: scenes and lines that name it, mentions, and changes of speaker between it and the ego (adjacent: entity)."""
    near = adjacent.groupBy(entity).agg(F.count("*").alias("n_adjacent"))
    own = matches.groupBy(entity).agg(F.count_distinct(scene).alias("n_scenes"), F.count_distinct(line).alias("n_lines"), F.sum("n").alias("n_mentions"))
    return own.join(near, entity, "full_outer").select(entity, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_scenes", "n_lines", "n_mentions", "n_adjacent")))


def voice_evidence(voices: DataFrame, voice: str, parts: dict[str, tuple[str, str]], entities: DataFrame, entity: str, special: Column | None = None) -> DataFrame:
    """(voice, entity, reasons): categorised lines that name an entity, with the reasons in the order of `parts`.

    parts: reason -> (text column of voices, alias column of entities, one alias a row or null); special: an (entity, category) rule over
    the columns of voices that gives the entity concerned, or null; its reason comes last. Texts without any are left out."""
    found, order = None, {}
    for i, (reason, (text, alias)) in enumerate(parts.items()):
        own = alias_matches(voices.where(F.col(text).isNotNull()), voice, text, entities.where(F.col(alias).isNotNull()).select(entity, alias).distinct(), entity, alias)
        rows = own.select(voice, entity, F.struct(F.lit(i).alias("i"), F.lit(reason).alias("reason")).alias("r"))
        found = rows if found is None else found.union(rows)
    if special is not None:
        found = found.union(voices.select(voice, special.alias(entity), F.struct(F.lit(len(parts)).alias("i"), F.lit("category_rule").alias("reason")).alias("r")).where(F.col(entity).isNotNull()))
    return found.groupBy(voice, entity).agg(F.transform(F.array_sort(F.collect_set("r")), lambda r: r["reason"]).alias("reasons"))
