"""Queries over aliases, evidence, rules and conversation state."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.functions import text as T
from corpuslake.operators import activation, cards, checks, dialogue, retrieval
from corpuslake.plans.registry import Registry, table
from corpuslake.streaming import sessions

Q = Registry()

#: Two words of an item, and a few letters around one that is not ASCII, which stand inside words.
ALIASES = """a AS (SELECT DISTINCT entity, alias FROM (SELECT item_id AS entity, regexp_extract(text, '[A-Za-z]+ [a-z]+') AS alias FROM benchmark
UNION ALL SELECT item_id, regexp_extract(text, '[a-z]?[éèêçöüäñóí][a-z]') FROM benchmark UNION ALL SELECT item_id, 'x' FROM benchmark) WHERE alias <> '')"""


def aliases(spark, sf_dir):
    one = lambda p: F.regexp_extract("text", p, 0)
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entity"), F.explode(F.array(one("[A-Za-z]+ [a-z]+"), one("[a-z]?[éèêçöüäñóí][a-z]"), F.lit("x"))).alias("alias"))
    return rows.where("alias <> ''").distinct()


@Q(f"""WITH {ALIASES} SELECT DISTINCT doc_id, entity, alias FROM documents JOIN a ON length(alias) >= 2 AND
CASE WHEN regexp_matches(alias, '^[A-Za-z ]+$') THEN regexp_matches(lower(text), '(^|[^a-z])' || lower(alias) || '([^a-z]|$)') ELSE contains(lower(text), lower(alias)) END""")
def alias_names(spark, sf_dir):
    return retrieval.alias_matches(table(spark, sf_dir, "documents"), "doc_id", "text", aliases(spark, sf_dir), "entity", "alias").select("doc_id", "entity", "alias")


@Q(f"""WITH {ALIASES} SELECT DISTINCT conv_id, turn, entity, alias FROM conversations JOIN a ON
CASE WHEN regexp_matches(alias, '^[\\x00-\\x7F]+$') THEN regexp_matches(lower(text), '(^|[^a-z0-9_])' || lower(alias) || '([^a-z0-9_]|$)') ELSE contains(text, alias) END""")
def alias_names_runtime(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    return retrieval.alias_matches(turns, "key", "text", aliases(spark, sf_dir), "entity", "alias", "runtime").select("key.conv_id", "key.turn", "entity", "alias")


@Q("""WITH e(entity, alias) AS (VALUES ('user', 'én'), ('user', 'éo'), ('system', 'ün')), l AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
m AS (SELECT entity, conv_id, turn, (length(lower(text)) - length(replace(lower(text), alias, ''))) // length(alias) AS n FROM l JOIN e ON contains(lower(text), alias)),
s AS (SELECT entity, count(DISTINCT conv_id) AS n_scenes, count(DISTINCT (conv_id, turn)) AS n_lines, sum(n)::BIGINT AS n_mentions FROM m GROUP BY 1),
j AS (SELECT CASE WHEN role = 'assistant' THEN nxt ELSE role END AS entity, count(*) AS n_adjacent FROM l WHERE nxt IS NOT NULL AND (role = 'assistant') <> (nxt = 'assistant') GROUP BY 1)
SELECT entity, coalesce(n_scenes, 0) AS n_scenes, coalesce(n_lines, 0) AS n_lines, coalesce(n_mentions, 0) AS n_mentions, coalesce(n_adjacent, 0) AS n_adjacent FROM s FULL JOIN j USING (entity)""")
def entity_stats(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    names = spark.createDataFrame([("user", "én"), ("user", "éo"), ("system", "ün")], "entity string, alias string")
    found = retrieval.alias_matches(turns, "key", "text", names, "entity", "alias").withColumn("scene", F.col("key.conv_id"))
    near = dialogue.adjacent(turns, "conv_id", "turn", "role", "assistant").withColumnRenamed("other", "entity")
    return retrieval.entity_stats(found, "entity", "scene", "key", near)


GRAMS = """b AS (SELECT conv_id, lower(string_agg(role || '：' || text, chr(10) ORDER BY turn)) AS body FROM conversations GROUP BY conv_id), n AS (SELECT count(*) AS total FROM b),
t AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS term FROM benchmark),
x AS (SELECT item_id, conv_id, term, (length(body) - length(replace(body, term, ''))) // length(term) AS c FROM b JOIN t ON contains(body, term)),
base AS (SELECT item_id, conv_id, sum(18.0 + 3.0 * least(length(term), 16) + 4.0 * least(c, 4) + CASE WHEN EXISTS (SELECT 1 FROM conversations v WHERE v.conv_id = x.conv_id AND role = 'assistant' AND contains(lower(text), term)) THEN 24.0 ELSE 0.0 END)::DOUBLE AS base FROM x GROUP BY 1, 2),
r AS (SELECT 'd' AS side, conv_id AS id, unnest(regexp_extract_all(body, '[a-z]+')) AS run FROM b UNION ALL SELECT 'q', item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM benchmark),
g AS (SELECT side, id, substr(run, i, w) AS gram, count(*) AS c FROM (SELECT *, unnest(range(1, length(run) - w + 2)) AS i FROM r, (VALUES (2), (3), (4)) v(w) WHERE length(run) >= w) GROUP BY ALL),
df AS (SELECT gram, count(*) AS df FROM g WHERE side = 'd' GROUP BY 1),
sh AS (SELECT item_id, base.conv_id, gram, df, least(q.c, d.c, 2) AS c, row_number() OVER (PARTITION BY item_id, base.conv_id ORDER BY df, length(gram) DESC, gram) AS rank FROM base JOIN g q ON q.side = 'q' AND q.id = item_id JOIN df USING (gram) JOIN g d ON d.side = 'd' AND d.id = base.conv_id AND d.gram = q.gram),
ex AS (SELECT item_id, conv_id, sum((ln((total + 1.0) / (df + 1)) + 1) * (length(gram) - 1) * c * 0.32 ORDER BY rank) AS extra FROM sh, n WHERE rank <= 80 AND df <= greatest(8, total // 5) GROUP BY 1, 2),
s AS (SELECT item_id, conv_id, base + coalesce(extra, 0) AS score FROM base LEFT JOIN ex USING (item_id, conv_id))"""


@Q(f"WITH {GRAMS} SELECT item_id, conv_id, rank, round(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, conv_id)::INT AS rank FROM s WHERE score >= 9) WHERE rank <= 8")
def gram_retrieval(spark, sf_dir):
    """Items' eight best conversations (a top-k report) by exact terms, the ego's use of them, and character grams."""
    turns, items = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "benchmark")
    terms = items.select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{7,})"), F.lit(1))).alias("term"))
    exact = retrieval.scene_terms(turns, "conv_id", "turn", "role", "text", "assistant", terms, "item_id", "term")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit("："), "text").alias("line")))), lambda x: x["line"]), "\n")
    scenes = turns.groupBy("conv_id").agg(F.lower(body).alias("body")).select("conv_id", T.ngrams(F.col("body"), "[a-z]+").alias("grams"))
    scored = retrieval.lexical_scores(items.select("item_id", T.ngrams(F.lower("text"), "[a-z]+").alias("grams")), "item_id", scenes, "conv_id", "grams", exact, top=8)
    top = retrieval.top_per_key(scored, ["item_id"], [F.desc(F.round("score", 6)), F.col("conv_id")], 8)
    return top.select("item_id", "conv_id", "rank", F.round("score", 3).alias("score"))


@Q("""WITH v AS (SELECT o_orderkey AS voice, 'about nation_' || (o_custkey % 25) AS title, 'saw 国Nation_' || (o_orderkey % 7) || '水' AS body, o_orderpriority AS other, o_orderstatus AS status FROM orders),
m AS (SELECT voice, n_name AS entity, list_filter([CASE WHEN contains(title, lower(n_name)) THEN 'title' END, CASE WHEN contains(lower(body), lower(n_name)) THEN 'text' END,
CASE WHEN n_nationkey = 0 AND other = '5-LOW' THEN 'other_language' END, CASE WHEN n_nationkey = 0 AND status = 'P' THEN 'category_rule' END], lambda x: x IS NOT NULL) AS r FROM v, nation)
SELECT voice, entity, array_to_string(r, ',') AS reasons FROM m WHERE len(r) > 0""")
def voice_evidence(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    voices = o.select(F.col("o_orderkey").alias("voice"), F.concat(F.lit("about nation_"), F.col("o_custkey") % 25).alias("title"), F.concat(F.lit("saw 国Nation_"), F.col("o_orderkey") % 7, F.lit("水")).alias("body"), F.col("o_orderpriority").alias("other"), "o_orderstatus")
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("entity"), F.col("n_name").alias("alias"), F.when(F.col("n_nationkey") == 0, "low").alias("other_alias"))
    out = retrieval.voice_evidence(voices, "voice", {"title": ("title", "alias"), "text": ("body", "alias"), "other_language": ("other", "other_alias")}, names, "entity", F.when(F.col("o_orderstatus") == "P", "NATION_0"))
    return out.select("voice", "entity", F.array_join("reasons", ",").alias("reasons"))


@Q("""WITH p AS (SELECT conv_id, turn, text || CASE WHEN turn % 3 = 1 THEN '—' ELSE '' END AS content, lag(text) OVER w || CASE WHEN turn % 4 = 1 THEN '[last]' ELSE '' END || CASE WHEN conv_id % 5 = 0 THEN '[fight]' ELSE '' END AS prompt, CASE WHEN conv_id % 2 = 0 THEN 'voice' ELSE 'scene' END AS source
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, unnest(list_filter([CASE WHEN length(regexp_replace(content, '[^0-9A-Za-z\\x{3400}-\\x{9FFF}]', '', 'g')) < 60 THEN 'too_short' END, CASE WHEN regexp_matches(regexp_replace(content, '\\s+$', ''), '—$') THEN 'fragment_ending' END,
CASE WHEN source <> 'voice' AND NOT contains(prompt, '[last]') THEN 'no_last_line' END, CASE WHEN source = 'voice' AND contains(prompt, '[fight]') THEN 'combat_voice' END], lambda x: x IS NOT NULL)) AS rule FROM p WHERE prompt IS NOT NULL""")
def profile_violations(spark, sf_dir):
    from pyspark.sql import Window as W

    mark = lambda test, text: F.when(test, F.lit(text)).otherwise(F.lit(""))
    t = table(spark, sf_dir, "conversations").withColumn("prev", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("prev is not null")
    rows = t.select(F.struct("conv_id", "turn").alias("key"), F.concat("text", mark(F.col("turn") % 3 == 1, "—")).alias("content"), F.concat("prev", mark(F.col("turn") % 4 == 1, "[last]"), mark(F.col("conv_id") % 5 == 0, "[fight]")).alias("prompt"), F.when(F.col("conv_id") % 2 == 0, "voice").otherwise("scene").alias("source"))
    rules = checks.profile_rules(F.col("content"), F.col("prompt"), F.col("source"), F.when(F.col("source") == "voice", "c"), "voice", "[last]", "[fight]", 60)
    return checks.violations(rows, "key", rules).select("key.conv_id", "key.turn", "rule")


@Q("""WITH r AS (SELECT n_nationkey::INT AS id, CASE n_nationkey % 4 WHEN 0 THEN 'include' WHEN 1 THEN 'exclude' WHEN 2 THEN 'include' ELSE 'maybe' END AS decision, n_name AS want, CASE WHEN n_nationkey % 5 = 1 THEN 'other' ELSE n_name END AS name FROM nation)
SELECT id, array_to_string(list_filter([CASE WHEN decision = 'maybe' THEN 'unknown decision' END, CASE WHEN name <> want THEN 'name is not ' || want END, CASE WHEN id % 3 = 0 THEN 'aliases holds forbidden names: BAD' END, CASE WHEN id % 7 = 2 THEN 'keys is no list' END,
CASE WHEN id % 6 = 5 THEN 'formal names are missing' END, CASE WHEN decision = 'include' AND id % 8 = 2 THEN 'included without evidence' END], lambda x: x IS NOT NULL), ';') AS errors FROM r""")
def result_errors(spark, sf_dir):
    k, name = F.col("n_nationkey").cast("int"), F.col("n_name")
    decision = F.when(k % 4 == 1, "exclude").when(k % 4 == 3, "maybe").otherwise("include")
    names = F.concat(F.when(k % 6 == 5, F.array(F.lit("x"))).otherwise(F.array(name)), F.when(k % 3 == 0, F.array(F.lit("BAD"))).otherwise(F.array().cast("array<string>")))
    out = checks.result_errors(decision, {"name": F.when(k % 5 == 1, "other").otherwise(name)}, {"name": name}, {"aliases": names, "keys": F.when(k % 7 != 2, F.array(name))}, F.array(F.lit("bad")), [name], {"evidence": F.when(k % 8 != 2, F.lit("seen"))})
    return table(spark, sf_dir, "nation").select(k.alias("id"), F.array_join(out, ";").alias("errors"))


@Q("""WITH c AS (SELECT l_orderkey, list_distinct(list(l_linenumber)) AS ids, count(*) AS n, max((l_linenumber > 4)::INT) = 1 AS far, max((l_quantity > 25 AND l_linenumber > 5)::INT) = 1 AS scene, max((NOT CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN l_linestatus = 'O' ELSE l_linestatus = 'F' END)::INT) = 1 AS odd,
max((l_returnflag = 'A' AND l_quantity <= 25)::INT) = 1 AS bare FROM lineitem GROUP BY 1)
SELECT l_orderkey, unnest(list_filter([CASE WHEN l_orderkey % 9 = 0 THEN 'field_owner' END, CASE WHEN l_orderkey % 4 = 0 THEN 'repeated_string_0' END, CASE WHEN NOT list_has_all(ids, [1, 2, 3, 4]) THEN 'missing_fact' END, CASE WHEN far THEN 'foreign_fact' END, CASE WHEN len(ids) <> n THEN 'repeated_fact' END,
CASE WHEN scene THEN 'foreign_scene' END, CASE WHEN odd THEN 'status_and_mode' END, CASE WHEN bare THEN 'firsthand_without_scene' END, CASE WHEN l_orderkey % 6 = 0 THEN 'forbidden_word' END], lambda x: x IS NOT NULL)) AS rule FROM c""")
def viewpoint_violations(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "A", "firsthand").when(F.col("l_returnflag") == "N", "heard").otherwise("unknown")
    one = F.struct(F.col("l_linenumber").cast("string").alias("fact_id"), status.alias("epistemic_status"), F.col("l_linestatus").alias("response_mode"), F.when(F.col("l_quantity") > 25, F.array(F.col("l_linenumber").cast("string"))).otherwise(F.array().cast("array<string>")).alias("evidence_scene_ids"))
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(one).alias("a"))
    numbers, k = lambda n: F.array(*(F.lit(str(i)) for i in range(1, n + 1))), F.col("l_orderkey")
    allowed = {"firsthand": ("O", "F"), "heard": ("O",), "unknown": ("F",)}
    rules = checks.viewpoint_rules(allowed, numbers(4), F.col("a"), numbers(5), {"owner": (F.when(k % 9 != 0, "me"), F.lit("me"))}, (F.when(k % 4 == 0, F.array(F.lit("x"), F.lit("x"))).otherwise(F.array(F.lit("x"))),), F.when(k % 6 == 0, "as an AI").otherwise("hello"), ("an AI",))
    return checks.violations(held, "l_orderkey", rules).select("l_orderkey", "rule")


@Q("""WITH r AS (SELECT doc_id, ['pass', 'revise', 'pass', 'maybe'][1 + doc_id % 4] AS verdict, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS n, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN substr(text, 1, 3) ELSE text END AS new, text FROM documents)
SELECT doc_id, unnest(list_filter([CASE WHEN verdict = 'maybe' THEN 'verdict' END, CASE WHEN verdict = 'pass' AND n > 0 THEN 'pass_with_issues' END, CASE WHEN verdict = 'pass' AND new <> text THEN 'pass_changes_text' END, CASE WHEN verdict = 'revise' AND n = 0 THEN 'revise_without_issues' END, CASE WHEN verdict = 'revise' AND trim(new) = '' THEN 'revise_without_text' END], lambda x: x IS NOT NULL)) AS rule FROM r""")
def review_violations(spark, sf_dir):
    k = F.col("doc_id")
    verdict = F.element_at(F.array(*map(F.lit, ("pass", "revise", "pass", "maybe"))), (k % 4 + 1).cast("int"))
    new = F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.substring("text", 1, 3)).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", verdict.alias("verdict"), F.when(k % 3 == 0, F.array(F.lit("i"))).otherwise(F.array().cast("array<string>")).alias("issues"), new.alias("safe_replacement"))
    return checks.violations(rows, "doc_id", checks.review_rules(F.col("text"))).select("doc_id", "rule")


@Q("""SELECT o_orderkey, o_orderstatus AS status, 'date' AS field FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus IN ('O', 'F') UNION ALL SELECT o_orderkey, o_orderstatus, 'priority' FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '5%'""")
def card_fields(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("date"), F.when(~F.startswith("o_orderpriority", F.lit("5")), F.col("o_orderpriority")).alias("priority"))
    return checks.missing_fields(o, "o_orderkey", "status", {"O": ("date",), "F": ("date", "priority")})


@Q("SELECT o_orderstatus AS status, 1000::BIGINT AS expected, count(*) AS found FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING count(*) <> 1000 UNION ALL SELECT 'P', 0, count(*) FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 0 UNION ALL SELECT 'X', 1000, 0 FROM (SELECT 1)")
def card_counts(spark, sf_dir):
    wanted = spark.createDataFrame([("O", 1000), ("F", 1000), ("X", 1000)], "status string, expected int")
    return checks.category_counts(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")), "status", wanted)


@Q("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 5 THEN 'stale' ELSE sha256('{"custkey":' || o_custkey || '}') END AS stated, CASE WHEN o_orderkey % 13 <> 7 THEN sha256('{"custkey":' || o_custkey || '}') END AS found FROM orders WHERE o_orderkey % 11 = 5 OR o_orderkey % 13 = 7""")
def card_lineage(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    own = T.canonical_hash(F.col("o_custkey").alias("custkey"))
    return checks.lineage_differences(o.select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 5, "stale").otherwise(own).alias("stated")), "o_orderkey", "stated", o.where("o_orderkey % 13 <> 7"), own)


@Q("SELECT event_id, 'secret' AS forbidden FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'tok\"en' FROM events WHERE event_id % 10 = 0")
def forbidden_keys(spark, sf_dir):
    k = F.col("event_id")
    json = F.concat(F.lit('{"a": [{"'), F.when(k % 3 == 0, "secret").otherwise("open"), F.lit('": 1}, {"'), F.when(k % 10 == 0, 'tok\\"en').otherwise("token"), F.lit('": {}}], "s": "\\"secret\\": 2"}'))
    return checks.nested_keys(table(spark, sf_dir, "events").select("event_id", json.alias("json")), "event_id", "json", ("secret", 'tok"en', "none"))


@Q("""SELECT 'version' AS problem, n_name AS value FROM nation WHERE n_nationkey % 10 = 4 UNION ALL SELECT 'repeated id', n_name FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 'empty id', '' FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'count', '29' FROM region WHERE r_regionkey = 0""")
def roster_check(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    version = lambda bad: F.when(bad, "v0").otherwise("v1").alias("version")
    rows = n.select(F.col("n_name").alias("id"), version(F.col("n_nationkey") % 10 == 4)).union(n.where("n_nationkey < 3").select("n_name", F.lit("v1"))).union(n.where("n_nationkey = 0").select(F.lit(" "), F.lit("v1")))
    return checks.roster_problems(rows, "id", "version", "v1", 30)


@Q("""WITH g AS (SELECT p_partkey // 2 AS id, p_name || CASE WHEN p_partkey < 20 THEN '' ELSE '#' || p_partkey END AS text, CASE WHEN p_partkey % 50 <> 7 THEN p_type END AS kind FROM part)
SELECT 'repeated id' AS problem, id::VARCHAR AS value FROM g GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'repeated text', min(id)::VARCHAR FROM g GROUP BY text HAVING count(*) > 1 UNION ALL SELECT 'empty kind', id::VARCHAR FROM g WHERE kind IS NULL UNION ALL SELECT 'count', count(*)::VARCHAR FROM g HAVING count(*) <> 76""")
def generated_check(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.floor(k / 2).alias("id"), F.concat("p_name", F.when(k < 20, F.lit("")).otherwise(F.concat(F.lit("#"), k))).alias("text"), F.when(k % 50 != 7, F.col("p_type")).alias("kind"))
    return checks.generated_problems(rows, "id", "text", ("kind",), 76)


@Q("""WITH w(lang, wanted) AS (VALUES ('en', 0.5::DOUBLE), ('de', 0.05::DOUBLE), ('xx', 0.45::DOUBLE)), f AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1), b AS (SELECT lang, wanted, coalesce(n, 0) AS n, coalesce(n / (SELECT sum(n) FROM f), 0)::DOUBLE AS share FROM w FULL JOIN f USING (lang))
SELECT lang, n, share, CASE WHEN wanted IS NULL THEN 'unknown split' WHEN n = 0 THEN 'empty split' ELSE 'share out of bounds' END AS problem FROM b WHERE wanted IS NULL OR n = 0 OR abs(share - wanted) > 0.02""")
def split_bounds(spark, sf_dir):
    return checks.split_problems(table(spark, sf_dir, "documents").where("lang is not null"), "lang", {"en": 0.5, "de": 0.05, "xx": 0.45}, 0.02)


PHRASES = {"acquaintance": ("and tha", "und ein"), "interaction": ("ion ",), "proposal": ("en",), "disclosure": ("the ",), "familiarity": ("er ",), "denial": ("in ",)}


@Q("""WITH p AS (SELECT conv_id, turn, role, lag(text) OVER w AS said, text || CASE WHEN conv_id % 8 = 0 THEN ' local NATION_' || conv_id % 25 ELSE '' END AS draft FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
a AS (SELECT * FROM p WHERE role = 'assistant' AND said IS NOT NULL),
c AS (SELECT a.*, n_name AS card, n_nationkey AS k, n_regionkey AS region FROM a JOIN nation ON n_nationkey = conv_id % 25 OR n_nationkey = 24 - turn),
r AS (SELECT conv_id, turn, card, k % 3 = 0 AS person, CASE WHEN k % 3 <> 0 AND k % 4 <> 0 AND (contains(draft, 'and tha') OR contains(draft, 'und ein')) THEN 2 WHEN k % 3 <> 0 AND k % 4 <> 0 AND contains(draft, 'ion ') THEN 3
WHEN k % 3 <> 0 AND k % 4 <> 0 AND conv_id % 5 = 0 AND contains(said, 'en') AND NOT contains(draft, 'the ') THEN 4 WHEN k % 3 <> 0 AND k % 2 <> 0 AND contains(draft, 'er ') THEN 5 WHEN k % 3 <> 0 AND region <> 2 AND conv_id % 2 = 0 AND contains(draft, 'local ' || card) THEN 6
WHEN k % 3 = 0 AND k % 2 = 1 AND contains(draft, 'in ') THEN 7 END AS rule FROM c),
m AS (SELECT conv_id, turn, min(n_name) AS card FROM a JOIN nation ON n_regionkey = conv_id % 5 WHERE conv_id % 6 = 0 GROUP BY 1, 2, draft HAVING NOT bool_or(contains(draft, n_name))),
e AS (SELECT conv_id, turn, (CASE WHEN person THEN 2 ELSE 1 END, card, rule) AS b FROM r WHERE rule IS NOT NULL UNION ALL SELECT conv_id, turn, (0, card, 1) FROM m)
SELECT conv_id, turn, ['missing_contact', 'claimed_acquaintance', 'claimed_interaction', 'missing_disclosure', 'exaggerated_familiarity', 'wrong_region', 'denied_interaction'][min(b)[3]] AS rule, min(b)[2] AS card FROM e GROUP BY 1, 2""")
def answer_rules(spark, sf_dir):
    from pyspark.sql import Window as W

    conv, n = F.col("conv_id"), table(spark, sf_dir, "nation")
    local = F.when(conv % 8 == 0, F.concat(F.lit(" local NATION_"), conv % 25)).otherwise(F.lit(""))
    t = table(spark, sf_dir, "conversations").withColumns({"user": F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")), "draft": F.concat("text", local)}).where("role = 'assistant' and user is not null")
    a = t.select(F.struct("conv_id", "turn").alias("answer"), "conv_id", "turn", "user", "draft")
    pairs = a.withColumn("n_nationkey", F.explode(F.array_distinct(F.array(conv % 25, 24 - F.col("turn"))))).join(n, "n_nationkey")
    k = F.col("n_nationkey")
    asked = F.when(conv % 2 == 0, F.array(F.struct(F.lit(2).alias("region"), F.lit("Land").alias("name")))).otherwise(F.array().cast("array<struct<region:int,name:string>>"))
    pairs = pairs.select("answer", F.col("n_name").alias("card"), F.when(k % 3 == 0, "character").otherwise("relationship").alias("kind"), (k % 4 == 0).alias("acquainted"), F.when(k % 2 == 0, "close").otherwise("casual").alias("familiarity"), F.col("n_regionkey").alias("region"), (k % 2 == 1).alias("direct"), "user", "draft", (conv % 5 == 0).alias("user_names"), F.array("n_name").alias("aliases"), asked.alias("user_regions"))
    contacts = a.where("conv_id % 6 = 0").join(n, conv % 5 == F.col("n_regionkey")).select("answer", F.col("n_regionkey").alias("region"), F.col("n_name").alias("card"), F.contains("draft", "n_name").alias("named"))
    return checks.answer_conflicts(pairs, contacts, "answer", PHRASES, ("close",)).select("answer.conv_id", "answer.turn", "rule", "card")


@Q("""SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN replace(CASE WHEN doc_id % 6 = 0 THEN substr(text, 1, 40) ELSE text END, 'e', 'E') ELSE text END) AS text_sha FROM documents""")
def phrase_reviews(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id")
    own = d.where("doc_id % 3 = 0").select("doc_id", F.lit("revise").alias("verdict"), F.when(k % 6 == 0, F.substring("text", 1, 40)).alias("replacement"))
    return cards.apply_reviews(d, own, "doc_id", "text", [("e", "E")]).select("doc_id", F.sha2("text", 256).alias("text_sha"))


@Q("""WITH t AS (SELECT user_id, event_id, event_type AS card, ts FROM events), p AS (SELECT a.event_id, a.user_id, b.card, max((b.ts, b.event_id)) AS ord FROM t a JOIN t b ON a.user_id = b.user_id AND (b.ts, b.event_id) <= (a.ts, a.event_id) GROUP BY 1, 2, 3)
SELECT event_id, string_agg(card, ',' ORDER BY ord DESC) AS active FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ord DESC) AS r FROM p) WHERE r <= 3 GROUP BY 1""")
def active_after_each(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("card"), F.struct("ts", "event_id").alias("at"))
    out = activation.active_after_each(t.select("user_id", "event_id", "card", "at").withColumn("at", F.concat(F.date_format("at.ts", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("event_id").cast("string"), 20, "0"))), "user_id", "at", "card", 3)
    return out.select("event_id", F.array_join("active", ",").alias("active"))


@Q("""WITH t AS (SELECT user_id, event_type AS card, max((ts, event_id)) AS ord FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ord DESC) AS r FROM t)
SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'c,b' ELSE string_agg(card, ',' ORDER BY r) FILTER (WHERE r <= 2) END AS active FROM r GROUP BY user_id""")
def restored_sets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    saved = e.select("user_id").distinct().withColumn("active", F.when(F.col("user_id") % 2 == 0, F.array(*map(F.lit, "abc"))))
    out = sessions.restored_sets(saved, "user_id", "active", e.withColumnRenamed("event_type", "card"), ["ts", "event_id"], "card", 2)
    return out.select("user_id", F.array_join("active", ",").alias("active"))


def _turn_stream(spark, sf_dir):
    return sessions.events(spark, f"{sf_dir}/events.parquet")


@Q("""WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type, ts FROM events), w AS (SELECT user_id, event_type || '_card' AS card, max((ts, event_id)) AS ord FROM l GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ord DESC) AS r FROM w)
SELECT user_id, 'character=' || (SELECT string_agg(k, ',' ORDER BY a DESC) FROM (SELECT 'any' AS k, 1 AS a)) || ';relationship=;world=' || string_agg(card, ',' ORDER BY r) FILTER (WHERE r <= 2) AS active FROM r GROUP BY user_id""")
def activation_stream(spark, sf_dir):
    """Turns that name an event type by a long and a short alias, of which the long one shadows the other card's."""
    turns = _turn_stream(spark, sf_dir).select("user_id", "event_id", "ts", F.concat(F.lit("the "), "event_type", F.lit(" thing, see 水国")).alias("text"))
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    long = kinds.select(F.lit("world").alias("kind"), F.concat("event_type", F.lit("_card")).alias("card"), F.concat("event_type", F.lit(" thing")).alias("alias"))
    short = kinds.select(F.lit("world"), F.concat("event_type", F.lit("_short")), F.col("event_type"))
    named = long.union(short).union(spark.createDataFrame([("character", "any", "水国"), ("relationship", "none", "nobody")], "kind string, card string, alias string"))
    out = sessions.replay(spark, turns, lambda t: sessions.activations(t, named, {"character": None, "relationship": 4, "world": 2}, **sessions.STORED))
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return out.join(last, ["user_id", "event_id"]).select("user_id", "active")


@Q("""WITH RECURSIVE o AS (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, length(props) AS size, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, []::VARCHAR[] AS roles, []::BIGINT[] AS sizes, 0::BIGINT AS compacted, 0::BIGINT AS compactions FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT user_id, i, event_id, roles[older + 1:], sizes[older + 1:], older, compactions + (older > 0)::BIGINT FROM (
    SELECT *, CASE WHEN n >= 3 AND list_sum(sizes) >= 80 THEN greatest(0, n - stay - (stay < n AND roles[n - stay + 1] = 'assistant' AND roles[n - stay] = 'user')::BIGINT) ELSE 0 END AS older FROM (
        SELECT *, least(n - 1, 4 + (roles[-1] = 'user')::BIGINT) AS stay FROM (
            SELECT o.user_id, o.i, o.event_id, list_append(r.roles, o.role) AS roles, list_append(r.sizes, o.size) AS sizes, len(r.roles) + 1 AS n, r.compactions FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1))))
SELECT user_id, event_id, compacted, len(roles)::BIGINT AS kept, compactions FROM r WHERE i > 0""")
def compaction_split_stream(spark, sf_dir):
    turns = _turn_stream(spark, sf_dir).select("user_id", "event_id", "ts", F.when(F.col("event_id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.length("props").cast("long").alias("size"))
    return sessions.replay(spark, turns, lambda t: sessions.compaction_splits(t, 100, **sessions.STORED))
