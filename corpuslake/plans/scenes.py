"""Queries over lines, scenes and prompts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslake.functions import text as T
from corpuslake.operators import align, cards, dedup, dialogue, quality, reports, retrieval, scenes, sft
from corpuslake.plans.registry import Registry, table

Q = Registry()


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


MARKED = "CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN text || ' (Test)' WHEN 2 THEN '{NICKNAME} ' || text ELSE '' END"


def marked():
    k = F.col("turn") % 4
    return F.when(k == 0, F.col("text")).when(k == 1, F.concat("text", F.lit(" (Test)"))).when(k == 2, F.concat(F.lit("{NICKNAME} "), "text")).otherwise(F.lit(""))


@Q(f"""WITH m AS (SELECT *, {MARKED} AS line, CASE WHEN conv_id % 5 = 0 THEN 'assistant & user' ELSE role END AS speaker, CASE WHEN conv_id % 3 = 0 THEN '$HIDDEN test' ELSE 'Discarded' END AS meta FROM conversations)
SELECT conv_id, turn, contains(speaker, 'assistant') AND speaker <> 'assistant' AS joint_speaker, regexp_matches(line, '\\{{[^}}]+\\}}|<[^>]+>') OR regexp_matches(line, '(^|\\n)#') AS contains_markup, conv_id % 3 = 0 AS contains_hidden_marker,
turn % 4 = 1 AS text_test_marker, false AS metadata_test_marker, conv_id % 3 <> 0 AS discarded_marker, turn % 4 = 3 OR regexp_replace(line, '\\s', '', 'g') = '' AS empty_text FROM m""")
def line_flags(spark, sf_dir):
    speaker = F.when(F.col("conv_id") % 5 == 0, "assistant & user").otherwise(F.col("role"))
    meta = F.array(F.when(F.col("conv_id") % 3 == 0, "$HIDDEN test").otherwise("Discarded"))
    flags = scenes.line_flags(speaker, marked(), F.lit("assistant"), meta)
    return turns(spark, sf_dir).select("conv_id", "turn", flags.alias("f")).select("conv_id", "turn", "f.*")


@Q("""SELECT conv_id, conv_id % 4 = 0 OR max((turn = 1)::INT) = 1 AND conv_id % 6 = 1 AS hidden, conv_id % 4 = 1 AS test FROM conversations GROUP BY conv_id""")
def scene_flags(spark, sf_dir):
    said = F.when((F.col("turn") == 1) & (F.col("conv_id") % 6 == 1), F.concat(F.lit("$Hidden "), "text")).otherwise(F.col("text"))
    held = turns(spark, sf_dir).groupBy("conv_id").agg(F.collect_list(F.struct(said.alias("text"))).alias("turns"))
    objective = F.when(F.col("conv_id") % 4 == 0, "go $hidden").otherwise("go")
    flags = scenes.scene_flags(objective, F.col("turns"), F.array(F.when(F.col("conv_id") % 4 == 1, "a (TEST) x").otherwise("x")))
    return held.select("conv_id", flags.alias("f")).select("conv_id", "f.*")


@Q("""WITH s AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN lower(s_name) || ' (old)' WHEN 2 THEN s_name || '（' || s_nationkey || '）' ELSE 'x ' || s_name END AS speaker, s_name FROM supplier)
SELECT s_suppkey, contains(speaker, s_name) AS has, contains(lower(speaker), lower(s_name)) AS folded, speaker = s_name OR starts_with(speaker, s_name || '(') OR starts_with(speaker, s_name || '（') AS bracketed FROM s""")
def speaker_rules(spark, sf_dir):
    k, name = F.col("s_suppkey") % 4, F.col("s_name")
    speaker = F.when(k == 0, name).when(k == 1, F.concat(F.lower(name), F.lit(" (old)"))).when(k == 2, F.concat(name, F.lit("（"), F.col("s_nationkey").cast("string"), F.lit("）"))).otherwise(F.concat(F.lit("x "), name))
    is_ = lambda mode: scenes.speaker_is(speaker, F.array(name), mode)
    return table(spark, sf_dir, "supplier").select("s_suppkey", is_("contains").alias("has"), is_("folded").alias("folded"), is_("bracketed").alias("bracketed"))


@Q("""SELECT doc_id, to_json({'id': d.doc_id, 'lang': d.lang})::VARCHAR AS document, CASE WHEN l.doc_id IS NOT NULL THEN to_json({'id': l.doc_id, 'quality': l.quality})::VARCHAR END AS label FROM documents d LEFT JOIN labels l USING (doc_id)""")
def compact_sides(spark, sf_dir):
    d, own = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label_id")
    both = d.join(own, F.col("doc_id") == F.col("label_id"), "left")
    left = scenes.compact_side({"id": F.col("doc_id"), "lang": F.col("lang")})
    right = scenes.compact_side({"id": F.col("label_id"), "quality": F.col("quality")})
    return both.select("doc_id", F.to_json(left).alias("document"), F.to_json(right).alias("label"))


@Q("SELECT n_nationkey, n_name FROM nation")
def only_known_fields(spark, sf_dir):
    return scenes.only_present(table(spark, sf_dir, "nation"), ["n_nationkey", "absent", "n_name"])


@Q("""WITH c AS (SELECT conv_id, turn, role, text, lag(text, 1) OVER w AS p1, lag(text, 2) OVER w AS p2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, 'completion' AS location, sha256(text) AS value_sha FROM c UNION ALL SELECT conv_id, turn, CASE WHEN p2 IS NULL THEN 'context_0' ELSE 'context_1' END, sha256(p1) FROM c WHERE p1 IS NOT NULL UNION ALL SELECT conv_id, turn, 'context_0', sha256(p2) FROM c WHERE p2 IS NOT NULL""")
def source_strings(spark, sf_dir):
    from corpuslake.operators import dialogue

    rows = dialogue.rolling_context(turns(spark, sf_dir), "conv_id", "turn", ["role", "text"], 2).withColumn("key", F.struct("conv_id", "turn"))
    return scenes.source_strings(rows, "key").select("key.conv_id", "key.turn", "location", F.sha2("value", 256).alias("value_sha"))


@Q("SELECT n_regionkey::INT AS region, n_name AS name, n_nationkey::INT AS id FROM nation")
def roster_rows(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    nodes = n.groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("int").alias("region"), F.lit("x").alias("other"))).alias("nodes"))
    return scenes.roster(nodes, "nodes", ["region", "name", "id"], "id")


@Q("""SELECT n_nationkey::INT AS n_nationkey, 'region' AS field, n_regionkey::VARCHAR AS stated, CASE WHEN n_nationkey % 4 = 0 THEN '9' ELSE n_regionkey::VARCHAR END AS found FROM nation WHERE n_nationkey % 4 = 0
UNION ALL SELECT n_nationkey, 'name', n_name, NULL FROM nation WHERE n_nationkey % 10 = 3""")
def projection_check(spark, sf_dir):
    from corpuslake.operators import checks

    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), F.col("n_regionkey").cast("string").alias("region"), F.col("n_name").alias("name"))
    full = n.select("n_nationkey", F.when(F.col("n_nationkey") % 4 == 0, "9").otherwise(F.col("region")).alias("region"), F.when(F.col("n_nationkey") % 10 != 3, F.col("name")).alias("name"), F.lit("t").alias("runtime"))
    return checks.projection_differences(scenes.without(n.withColumn("runtime", F.lit("u")), "runtime"), full, "n_nationkey")


KEYS = "k AS (SELECT conv_id, list_sort(list(DISTINCT turn)) AS ids FROM conversations WHERE role <> 'system' GROUP BY conv_id)"


@Q(f"""WITH {KEYS}, e AS (SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN [] ELSE ids END AS ids FROM k)
SELECT array_to_string(ids, ',') AS ids, min(conv_id) AS conv_id, count(*) AS scenes FROM e GROUP BY ids, CASE WHEN conv_id % 7 = 0 THEN conv_id // 21 END""")
def canonical_scenes(spark, sf_dir):
    """Every seventh scene has no ids; those are told apart by a key of their own, which three of them share."""
    rows = turns(spark, sf_dir).where("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_set("turn")).alias("ids"))
    rows = rows.withColumns({"ids": F.when(F.col("conv_id") % 7 == 0, F.array().cast(rows.schema["ids"].dataType)).otherwise(F.col("ids")), "own": F.floor(F.col("conv_id") / 21)})
    out = dedup.canonical(rows.withColumn("source", F.col("conv_id").cast("string")), "ids", [F.col("conv_id")], "source", ["own"])
    return out.select(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), "conv_id", F.col("source_occurrence_count").alias("scenes"))


CHAT = r"""l AS (SELECT conv_id, turn, role, CASE turn % 6 WHEN 1 THEN '…' || text WHEN 2 THEN text || '—— ' WHEN 3 THEN substr(text, 1, 9) WHEN 4 THEN 'Well, ' || text WHEN 5 THEN CASE WHEN conv_id % 2 = 0 THEN '«Oh ...' ELSE text END ELSE text END AS line,
CASE WHEN conv_id % 11 = 0 THEN '…' WHEN conv_id % 4 = 0 THEN '(' || text || ')' ELSE text END AS said, CASE WHEN turn % 2 = 0 THEN 'choice' ELSE 'dialogue' END AS kind, conv_id % 9 = 0 AS voice, conv_id % 2 = 0 AS combat, (conv_id + turn) % 50 = 0 AS mismatch FROM conversations),
p AS (SELECT *, lag(role) OVER w AS speaker, lag(said) OVER w AS before, lag(kind) OVER w AS how FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""
MEANT = "length(regexp_replace({}, '[^0-9A-Za-z\\x{{3400}}-\\x{{9FFF}}]', '', 'g'))"


def chat_lines(spark, sf_dir):
    k, c = F.col("turn") % 6, F.col("conv_id")
    line = F.when(k == 1, F.concat(F.lit("…"), "text")).when(k == 2, F.concat("text", F.lit("—— "))).when(k == 3, F.substring("text", 1, 9)).when(k == 4, F.concat(F.lit("Well, "), "text")).when((k == 5) & (c % 2 == 0), "«Oh ...").otherwise(F.col("text"))
    said = F.when(c % 11 == 0, "…").when(c % 4 == 0, F.concat(F.lit("("), "text", F.lit(")"))).otherwise(F.col("text"))
    rows = turns(spark, sf_dir).select("conv_id", "turn", F.col("role").alias("speaker"), line.alias("line"), said.alias("text"), F.when(F.col("turn") % 2 == 0, "choice").otherwise("dialogue").alias("kind"))
    return dialogue.rolling_context(rows, "conv_id", "turn", ["speaker", "text", "kind"], 1)


@Q(rf"""WITH {CHAT} SELECT conv_id, turn, CASE WHEN voice AND combat THEN 'combat_voice' WHEN NOT voice AND speaker IS NULL THEN 'scene_without_context' WHEN NOT voice AND speaker = 'assistant' THEN 'unmerged_own_turn' WHEN NOT voice AND speaker = 'system' THEN 'narration_transition'
WHEN NOT voice AND {MEANT.format('before')} < 2 THEN 'nonsemantic_last_utterance' WHEN NOT voice AND how = 'choice' AND regexp_full_match(before, '(?s)（.*）|[(].*[)]') THEN 'traveler_internal_monologue' WHEN NOT voice AND mismatch THEN 'known_semantic_mismatch'
WHEN regexp_matches(trim(line), '(?i)^\p{{P}}?(?:well|oh)[\p{{P}}\p{{S}}\s]*$') THEN 'filler_only' WHEN {MEANT.format('line')} < 10 THEN 'too_short' WHEN regexp_matches(trim(line), '(…|——|—)$') THEN 'fragment_ending' WHEN regexp_matches(line, '^(…|[.][.][.])') THEN 'leading_ellipsis'
WHEN regexp_matches(trim(line), '(?i)^\p{{P}}?(?:well)[\p{{P}}\p{{S}}\s]') THEN 'filler_start' END AS reason FROM p""")
def chat_exclusions(spark, sf_dir):
    c = F.col("conv_id")
    rules = scenes.chat_rules(F.col("line"), F.col("context_before"), "assistant", "system", ("well", "oh"), ("well",), voice=c % 9 == 0, combat=c % 2 == 0, mismatch=(c + F.col("turn")) % 50 == 0)
    return chat_lines(spark, sf_dir).select("conv_id", "turn", quality.first_reason(rules).alias("reason"))


@Q("""WITH f AS (SELECT doc_id, doc_id % 4 = 1 AS test_a, lang = 'de' AS gone_a, length(text) < 300 AS empty_a, l.doc_id IS NOT NULL AND toxic = 1 AS joint_b, l.doc_id IS NOT NULL AND quality = 0 AS meta_b FROM documents LEFT JOIN labels l USING (doc_id))
SELECT doc_id, array_to_string(list_filter([CASE WHEN test_a THEN 'text_test_marker' END, CASE WHEN gone_a THEN 'discarded_marker' END, CASE WHEN empty_a THEN 'empty_text' END, CASE WHEN joint_b THEN 'joint_speaker' END], lambda x: x IS NOT NULL), ',') AS reasons,
array_to_string(list_filter([CASE WHEN test_a THEN 'text_test_marker' END, CASE WHEN gone_a THEN 'discarded_marker' END, CASE WHEN empty_a THEN 'empty_text' END, CASE WHEN joint_b THEN 'joint_speaker' END, CASE WHEN meta_b THEN 'metadata_test_marker' END], lambda x: x IS NOT NULL), ',') AS strict FROM f""")
def pair_exclusions(spark, sf_dir):
    """A document's flags on one side, its label's on the other; without a label the other side is null."""
    d, own = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumn("there", F.lit(True))
    no = F.lit(False)
    flags = lambda **on: F.struct(*(on.get(n, no).alias(n) for n in scenes.FLAGS))
    left = flags(text_test_marker=F.col("doc_id") % 4 == 1, discarded_marker=F.col("lang") == "de", empty_text=F.length("text") < 300)
    right = F.when(F.col("there"), flags(joint_speaker=F.col("toxic") == 1, metadata_test_marker=F.col("quality") == 0))
    out = d.join(own, "doc_id", "left").select("doc_id", left.alias("l"), right.alias("r"))
    return out.select("doc_id", *(F.array_join(scenes.pair_exclusions(F.col("l"), F.col("r"), strict), ",").alias(name) for name, strict in (("reasons", False), ("strict", True))))


@Q("""SELECT a.conv_id, a.turn, b.conv_id IS NOT NULL AS counterpart_found, coalesce(b.role, '') AS other_speaker, sha256(coalesce(b.text, '')) AS other_sha FROM conversations a
LEFT JOIN (SELECT * FROM conversations WHERE conv_id % 3 <> 0) b ON a.conv_id = b.conv_id AND a.turn = b.turn""")
def paired_scenes(spark, sf_dir):
    ident = F.concat_ws("-", "conv_id", "turn")
    side = lambda df: df.groupBy("conv_id").agg(F.collect_list(ident).alias("ids"), F.collect_list(F.struct("turn", ident.alias("id"), F.col("role").alias("speaker"), "text")).alias("turns"))
    t = turns(spark, sf_dir)
    out = align.paired_scenes(side(t), side(t.where("conv_id % 3 <> 0")).drop("conv_id"), "ids", "turns")
    return out.select("conv_id", "turn.turn", "counterpart_found", "other_speaker", F.sha2("other_text", 256).alias("other_sha"))


@Q("SELECT l.doc_id, quality, lang FROM labels l JOIN documents USING (doc_id)")
def back_joined(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi")
    return align.back_joined(rows.select("doc_id", "quality"), table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


@Q("SELECT n_nationkey::INT AS position, n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM nation")
def zipped_lists(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("position"), "n_name")
    return align.zipped(n, n.select("position", F.when(F.col("position") % 2 == 0, "even").otherwise("odd").alias("kind")), "position")


@Q("""WITH s AS (SELECT doc_id, unnest(['{M#he' || doc_id % 3 || '}{F#she}', CASE WHEN doc_id % 2 = 0 THEN '{M#a}{F#b' || doc_id % 5 || '}' END]) AS raw FROM documents), c AS (SELECT raw, count(*) AS occurrences FROM s WHERE raw IS NOT NULL GROUP BY 1),
e AS (SELECT raw, doc_id FROM (SELECT raw, doc_id, row_number() OVER (PARTITION BY raw ORDER BY doc_id) AS r FROM s WHERE raw IS NOT NULL) WHERE r <= 5)
SELECT raw, occurrences, regexp_extract(raw, '\\{M#([^{}]*)\\}', 1) AS male, regexp_extract(raw, '\\{F#([^{}]*)\\}', 1) AS female, string_agg(doc_id, ',' ORDER BY doc_id) AS examples FROM c JOIN e USING (raw) GROUP BY 1, 2""")
def branch_inventory(spark, sf_dir):
    n = F.col("doc_id")
    value = F.concat(F.lit("see {M#he"), n % 3, F.lit("}{F#she} and "), F.when(n % 2 == 0, F.concat(F.lit("{M#a}{F#b"), n % 5, F.lit("}"))).otherwise(F.lit("")))
    out = reports.branch_inventory(table(spark, sf_dir, "documents").select("doc_id", value.alias("value")), "value", "doc_id")
    return out.select("raw", "occurrences", "male", "female", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


@Q("SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS included, count(*) FILTER (WHERE o_orderstatus = 'F') AS excluded, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS with_conflicts FROM orders")
def assembly_report(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "included").when(F.col("o_orderstatus") == "F", "excluded").otherwise("failed")
    return reports.assembly_report(table(spark, sf_dir, "orders").select(status.alias("status"), F.when(F.col("o_orderkey") % 10 == 0, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>")).alias("conflicts")), "status", "conflicts")


STATUS = "['firsthand', 'heard', 'common', 'unknown'][1 + l_linenumber % 4]"


@Q(f"""WITH a AS (SELECT l_orderkey, l_linenumber, {STATUS} AS status, l_returnflag AS mode, l_linestatus = 'O' AS restricted, l_quantity < 25 AS bare FROM lineitem)
SELECT 'status' AS report, status AS value, count(*) AS n FROM a GROUP BY 2 UNION ALL SELECT 'mode', mode, count(*) FROM a GROUP BY 2 UNION ALL SELECT 'warnings', NULL, count(*) FROM a WHERE restricted AND status = 'common'
UNION ALL SELECT 'errors', NULL, count(*) FROM a WHERE status = 'firsthand' AND bare UNION ALL SELECT 'tier', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def assessment_audit(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("firsthand", "heard", "common", "unknown"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    scene = F.when(F.col("l_quantity") < 25, F.array().cast("array<string>")).otherwise(F.array(F.lit("s")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("fact_id"), status.alias("epistemic_status"), F.col("l_returnflag").alias("response_mode"), scene.alias("evidence_scene_ids"), "l_linestatus")
    out = reports.assessment_audit(rows, "l_orderkey", F.col("l_linestatus") == "O", "o_orderpriority", table(spark, sf_dir, "orders"))
    total = lambda name, label: out[name].agg(F.count("*").alias("n")).select(F.lit(label).alias("report"), F.lit(None).cast("string").alias("value"), "n")
    counts = lambda name, label: out[name].toDF("value", "n").select(F.lit(label).alias("report"), "value", "n")
    return counts("status_counts", "status").union(counts("mode_counts", "mode")).union(total("warnings", "warnings")).union(total("errors", "errors")).union(counts("tier_counts", "tier"))


WORDS = {"scene": "Scene: ", "situation": "Now: ", "previous": "Before:", "last": "Answer:", "choice": "Choice", "someone": "Someone", "colon": ": ", "fallback": "Traveller: Hello?", "close": "Go on."}


@Q("""WITH c AS (SELECT conv_id, turn, role, text, lag(text, 1) OVER w AS p1, lag(role, 1) OVER w AS r1, lag(text, 2) OVER w AS p2, lag(role, 2) OVER w AS r2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
l AS (SELECT conv_id, turn, CASE WHEN r2 = 'user' THEN 'Choice' ELSE upper(r2) END || ': ' || p2 AS l2, CASE WHEN r1 = 'user' THEN 'Choice' ELSE upper(r1) END || ': ' || p1 AS l1, CASE WHEN conv_id % 3 = 1 THEN 'none' WHEN conv_id % 3 = 2 THEN 'Talk ' || conv_id ELSE 'win' END AS o FROM c WHERE role = 'assistant'),
h AS (SELECT *, 'Scene: Talk ' || conv_id || CASE WHEN o = 'win' THEN chr(10) || 'Now: win' ELSE '' END AS head FROM l)
SELECT conv_id, turn, sha256(concat_ws(chr(10), head, coalesce('Before:' || chr(10) || nullif(concat_ws(chr(10), l2, l1), ''), 'Traveller: Hello?'), 'Go on.')) AS plain_sha, sha256(concat_ws(chr(10), head, 'Before:' || chr(10) || l2, 'Answer:', l1, 'Go on.')) AS direct_sha FROM h""")
def scene_prompts(spark, sf_dir):
    from corpuslake.operators import dialogue

    t = turns(spark, sf_dir).withColumns({"speaker": F.col("role"), "kind": F.when(F.col("role") == "user", "choice").otherwise("dialogue")})
    rows = dialogue.rolling_context(t, "conv_id", "turn", ["speaker", "text", "kind"], 2).where("role = 'assistant'")
    title, k = F.concat(F.lit("Talk "), "conv_id"), F.col("conv_id") % 3
    objective = F.when(k == 1, F.lit("none")).when(k == 2, title).otherwise(F.lit("win"))
    prompt = lambda single: F.sha2(sft.scene_prompt(title, objective, F.col("context_before"), WORDS, {"assistant": "ASSISTANT", "system": "SYSTEM"}, single), 256)
    return rows.select("conv_id", "turn", prompt(False).alias("plain_sha"), prompt(True).alias("direct_sha"))


@Q("""WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Hello…' WHEN 1 THEN 'About ' || p_brand || ': ' || p_name WHEN 2 THEN p_name || '。' ELSE p_name END AS title, ['weather', 'food', ''][1 + p_partkey % 3] AS category, CASE WHEN p_size > 25 THEN 'combat' ELSE 'profile' END AS grp FROM part),
c AS (SELECT *, regexp_replace(title, '[…。. ]+$', '') AS short FROM t)
SELECT p_partkey, CASE WHEN short = 'Hello' THEN 'Who are you?' WHEN starts_with(short, 'About ') AND contains(short, ':') THEN 'What of ' || trim(substr(short, strpos(short, ':') + 1)) || '?' WHEN category = 'weather' THEN 'Now: ' || short || '.' WHEN category = 'food' THEN 'Eat ' || short || ' or ' || short || '?'
WHEN grp = 'combat' THEN '[Fight: ' || short || ']' ELSE 'Tell me of ' || short || '.' END AS prompt FROM c""")
def line_prompts(spark, sf_dir):
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    title = F.when(k == 0, F.lit("Hello…")).when(k == 1, F.concat(F.lit("About "), "p_brand", F.lit(": "), name)).when(k == 2, F.concat(name, F.lit("。"))).otherwise(name)
    category = F.element_at(F.array(*map(F.lit, ("weather", "food", ""))), (F.col("p_partkey") % 3 + 1).cast("int"))
    group = F.when(F.col("p_size") > 25, "combat").otherwise("profile")
    out = sft.line_prompt(title, category, group, {"Hello": "Who are you?"}, ("About ", ":", "What of %s?"), {"weather": "Now: %s.", "food": "Eat %s or %s?"}, "[Fight: %s]", "Tell me of %s.")
    return table(spark, sf_dir, "part").select("p_partkey", out.alias("prompt"))


@Q("""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER w AS prev FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT *, 'scene:talk:' || conv_id AS gid FROM p WHERE prev IS NOT NULL)
SELECT conv_id, turn, sha256(gid || chr(0) || prev || chr(0) || text) AS id, gid AS group_id, 2::BIGINT AS n_prompt, 'be kind' AS system, sha256(prev) AS user_sha, sha256(text) AS completion_sha FROM r""")
def sft_rows(spark, sf_dir):
    from corpuslake.operators import split

    rows = turns(spark, sf_dir).withColumn("prev", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("prev is not null")
    out = sft.sft_rows(rows, "be kind", F.col("prev"), F.col("text"), split.group_key(F.lit("talk"), F.col("conv_id")), F.lit("en"), conv_id=F.col("conv_id"), turn=F.col("turn"))
    at = lambda i: F.get("prompt", F.lit(i))["content"]
    return out.select("metadata.conv_id", "metadata.turn", "id", "group_id", F.size("prompt").cast("long").alias("n_prompt"), at(0).alias("system"), F.sha2(at(1), 256).alias("user_sha"), F.sha2("completion.content", 256).alias("completion_sha"))


@Q("""SELECT conv_id, turn, trim(w, ' .') IN ('ah', 'oh', 'well') AS filler, starts_with(w, 'ah ') OR starts_with(w, 'ah, ') OR starts_with(w, 'oops ') AS begins
FROM (SELECT conv_id, turn, ['ah…' , 'Oh. .', 'ah, ' || text, 'oops ' || text, 'well', text][1 + turn % 6] AS v, lower(replace(['ah…' , 'Oh. .', 'ah, ' || text, 'oops ' || text, 'well', text][1 + turn % 6], '…', '.')) AS w FROM conversations)""")
def filler_lines(spark, sf_dir):
    k, text = F.col("turn") % 6, F.col("text")
    v = F.when(k == 0, F.lit("ah…")).when(k == 1, F.lit("Oh. .")).when(k == 2, F.concat(F.lit("ah, "), text)).when(k == 3, F.concat(F.lit("oops "), text)).when(k == 4, F.lit("well")).otherwise(text)
    begins = T.starts_with_filler(v, ("ah", "oops")) & ~T.is_filler(v, ("ah+", "oh", "well"))
    return turns(spark, sf_dir).select("conv_id", "turn", T.is_filler(v, ("ah+", "oh", "well")).alias("filler"), begins.alias("begins"))


@Q("SELECT p_partkey, regexp_replace(p_name || ['', '…', '. 。', ' '][1 + p_partkey % 4], '[…。. ]+$', '') AS title FROM part")
def compact_titles(spark, sf_dir):
    end = F.element_at(F.array(*map(F.lit, ("", "…", ". 。", " "))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.compact_title(F.concat("p_name", end)).alias("title"))


@Q("""WITH c AS (SELECT p_partkey, [p_name, upper(p_brand), '', p_type, p_name, 'Old'] AS a, [lower(p_type), 'x'] AS bad FROM part)
SELECT p_partkey, array_to_string(list_filter([p_name, upper(p_brand)], lambda x: true), '|') AS aliases FROM (SELECT p_partkey, a[1] AS p_name, a[2] AS p_brand FROM c)""".replace("upper(p_brand)], lambda", "p_brand], lambda"))
def clean_alias_lists(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    out = T.clean_aliases(F.array("p_name", F.upper("p_brand"), F.lit(""), "p_type", "p_name", F.lit("Old")), F.array(F.lower("p_type"), F.lit("x")), ("old",))
    return p.select("p_partkey", F.array_join(out, "|").alias("aliases"))


@Q("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'é' || p_name ELSE p_name || '|' || p_brand END AS terms FROM part")
def address_terms(spark, sf_dir):
    terms = F.when(F.col("p_partkey") % 2 == 0, F.array("p_name", F.concat(F.lit("é"), "p_name"))).otherwise(F.array("p_name", "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.prefer_non_ascii(terms), "|").alias("terms"))


@Q("""WITH w AS (SELECT p_partkey, unnest([string_split(p_name, ' ')[1], string_split(p_name, ' ')[2], '水' || p_size, '火', p_type]) AS term FROM part)
SELECT p_partkey, term, lower(term) NOT IN ('economy', 'small') AND length(term) >= CASE WHEN regexp_matches(term, '^[\\x00-\\x7F]*$') THEN 4 ELSE 2 END AS safe FROM w""")
def safe_triggers(spark, sf_dir):
    words = F.split("p_name", " ")
    terms = F.array(F.get(words, F.lit(0)), F.get(words, F.lit(1)), F.concat(F.lit("水"), "p_size"), F.lit("火"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(terms).alias("term")).select("p_partkey", "term", T.safe_trigger(F.col("term"), ("economy", "small")).alias("safe"))


@Q("SELECT p_partkey, p_name || '|' || p_brand || '|' || regexp_replace(p_type, 'MY$', '') AS triggers FROM part")
def title_triggers(spark, sf_dir):
    title = F.concat_ws(" & ", "p_name", F.concat_ws(", ", "p_brand", "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.derived_triggers(F.array(title), ("MY",)), "|").alias("triggers"))


@Q("""WITH t AS (SELECT p_partkey, unnest(list_distinct([p_name, string_split(p_name, ' ')[1], string_split(p_name, ' ')[2], p_brand])) AS t FROM part) SELECT p_partkey, string_agg(t, '|' ORDER BY -length(t), t) AS terms FROM t WHERE t <> 'red' AND length(t) >= 3 GROUP BY 1""")
def exact_term_lists(spark, sf_dir):
    quoted = F.concat(F.lit("they say “"), "p_brand", F.lit("” and “x”"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.exact_terms(F.array("p_name"), quoted, (), ("red",)), "|").alias("terms"))


@Q("SELECT conv_id, turn, sha256(CASE WHEN turn % 2 = 0 THEN trim(text, ' ' || chr(10) || chr(9)) ELSE text END) AS text_sha FROM conversations")
def without_blocks(spark, sf_dir):
    block, even = F.lit("BE KIND. ALWAYS."), F.col("turn") % 2 == 0
    said = F.when(even, F.concat(block, F.lit("\n"), "text")).otherwise(F.col("text"))
    return turns(spark, sf_dir).select("conv_id", "turn", F.sha2(T.without_block(said, F.when(even, block).otherwise(F.lit(""))), 256).alias("text_sha"))


@Q("""SELECT conv_id, turn, sha256(CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || '[image]' ELSE '{"n":' || turn || '}' END) AS content_sha FROM conversations""")
def content_texts(spark, sf_dir):
    k = F.col("turn") % 3
    parts = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")))
    json = F.when(k == 0, F.regexp_extract(F.to_json(F.array("text")), r"(?s)^\[(.*)\]$", 1)).when(k == 1, F.to_json(parts)).otherwise(F.to_json(F.struct(F.col("turn").alias("n"))))
    return turns(spark, sf_dir).select("conv_id", "turn", F.sha2(T.content_text(F.parse_json(json)), 256).alias("content_sha"))


@Q("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open to ' WHEN 'F' THEN 'closed to ' ELSE 'ask about ' END || o_custkey AS line FROM orders""")
def policy_lines(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("%s to %d", T.labelled(F.col("o_orderstatus"), {"O": "open", "F": "closed"}, "ask about"), F.col("o_custkey")).alias("line")).withColumn("line", F.replace("line", F.lit("ask about to"), F.lit("ask about")))


@Q("SELECT conv_id, sha256('Talk ' || conv_id || chr(10) || 'go' || chr(10) || string_agg(role || '：' || text, chr(10) ORDER BY turn)) AS text_sha FROM conversations GROUP BY conv_id")
def search_texts(spark, sf_dir):
    held = turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("speaker"), "text"))).alias("turns"))
    return held.select("conv_id", F.sha2(scenes.search_text(F.concat(F.lit("Talk "), "conv_id"), F.lit("go"), F.col("turns")), 256).alias("text_sha"))


@Q("""SELECT conv_id, sha256(concat_ws(chr(10) || chr(10), '[index]' || chr(10) || 'Talk ' || conv_id, CASE WHEN s <> '' THEN '[boundaries]' || chr(10) || s END, '[summary]' || chr(10) || n)) AS context_sha
FROM (SELECT conv_id, count(*) AS n, coalesce(trim(string_agg(CASE WHEN role = 'system' THEN text END, ' ')), '') AS s FROM conversations GROUP BY conv_id)""")
def active_contexts(spark, sf_dir):
    held = turns(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n"), F.trim(F.array_join(F.collect_list(F.when(F.col("role") == "system", F.col("text"))), " ")).alias("s"))
    out = T.active_context({"summary": F.col("n").cast("string"), "boundaries": F.col("s"), "index": F.concat(F.lit("Talk "), "conv_id"), "topics": F.lit("  ")})
    return held.select("conv_id", F.sha2(out, 256).alias("context_sha"))


@Q("""SELECT n_nationkey::INT AS answer, string_agg(id, ',' ORDER BY id) AS cards, sha256(string_agg('about ' || id, chr(10) || chr(10) ORDER BY id)) AS context_sha
FROM (SELECT n_nationkey, n_name AS id FROM nation UNION SELECT n_nationkey, 'NATION_' || (n_nationkey * 7 % 25) FROM nation) WHERE id <> 'NATION_3' GROUP BY 1""")
def answer_contexts(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    answer = F.col("n_nationkey").cast("int").alias("answer")
    touched, named = n.select(answer, F.col("n_name").alias("card")), n.select(answer, F.concat(F.lit("NATION_"), F.col("n_nationkey") * 7 % 25).alias("card"))
    out = cards.answer_context(touched, named, "answer", "card", n.select(F.col("n_name").alias("card"), F.concat(F.lit("about "), "n_name").alias("text")), "text", "NATION_3")
    return out.select("answer", F.array_join("cards", ",").alias("cards"), F.sha2("context", 256).alias("context_sha"))


@Q("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{9,}')))[1:16], ',') AS matched FROM documents")
def capped_terms(spark, sf_dir):
    """The first 16 terms of each text (a report's cap)."""
    terms = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{9,})"), F.lit(1)))), 1, 16)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(terms, ",").alias("matched"))


@Q("""SELECT l_orderkey, string_agg(CASE WHEN s = 'a' THEN p END, ',' ORDER BY p) AS missing, string_agg(CASE WHEN s = 'b' THEN p END, ',' ORDER BY p) AS unasked FROM (

SELECT l_orderkey, l_partkey % 20 AS p, CASE WHEN max((l_linenumber <= 2)::INT) = 1 THEN 'a' ELSE 'b' END AS s FROM lineitem GROUP BY 1, 2 HAVING max((l_linenumber <= 2)::INT) <> max((l_linenumber > 2)::INT)) GROUP BY 1""")
def set_differences(spark, sf_dir):
    from corpuslake.operators import checks

    side = lambda test: F.collect_set(F.when(test, F.col("l_partkey") % 20))
    both = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(side(F.col("l_linenumber") <= 2).alias("a"), side(F.col("l_linenumber") > 2).alias("b"))
    out = both.select("l_orderkey", checks.set_difference(F.col("a"), F.col("b")).alias("d")).where("size(d.missing) + size(d.foreign) > 0")
    text = lambda xs: F.nullif(F.array_join(F.transform(xs, lambda x: x.cast("string")), ","), F.lit(""))
    return out.select("l_orderkey", text(F.col("d.missing")).alias("missing"), text(F.col("d.foreign")).alias("unasked"))
