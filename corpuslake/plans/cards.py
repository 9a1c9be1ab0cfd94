"""Card, review and check queries on stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.functions import text as T
from corpuslake.operators import cards, checks, content, quality, retrieval, scenes
from corpuslake.operators.tables import numbered
from corpuslake.plans.registry import Registry, table
from corpuslake.plans.sources import ADDED, row_sha
from corpuslake.streaming import sessions

Q = Registry()

TRIGGERS = """t AS (SELECT p_partkey AS owner, p_name AS trigger, 100 AS priority FROM part UNION ALL SELECT p_partkey, p_brand, 80 FROM part
UNION ALL SELECT p_partkey, unnest(string_split(p_name, ' ')), 20 FROM part UNION ALL SELECT p_partkey, p_brand || ' ' || p_type || ' ' || p_size, 90 FROM part)"""


@Q(f"""WITH {TRIGGERS}, b AS (SELECT lower(trigger) AS trigger, max(priority) AS priority FROM t GROUP BY 1)
SELECT trigger, priority, count(DISTINCT owner) AS n_owners, min(owner) AS first_owner, count(DISTINCT owner) > 1 AS shared
FROM (SELECT lower(trigger) AS trigger, owner, priority FROM t) JOIN b USING (trigger, priority) GROUP BY 1, 2 HAVING priority > 20 OR count(DISTINCT owner) = 1""")
def trigger_owners(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    own = lambda text, n: F.struct(text.alias("trigger"), F.lit(n).alias("priority"))
    brand = F.concat_ws(" ", "p_brand", "p_type", "p_size")
    every = F.concat(F.array(own(F.col("p_name"), 100), own(F.col("p_brand"), 80), own(brand, 90)), F.transform(F.split("p_name", " "), lambda w: own(w, 20)))
    rows = p.select(F.col("p_partkey").alias("owner"), F.explode(every).alias("x")).select("owner", "x.*")
    return cards.trigger_owners(rows, "trigger", "owner", "priority")


NODES = """i AS (SELECT s_nationkey AS nation, count(*) AS impression FROM supplier WHERE s_acctbal > 5000 GROUP BY 1),
x AS (SELECT c_nationkey AS nation, count(*) AS exclusion FROM customer WHERE c_acctbal < -900 GROUP BY 1),
sc AS (SELECT c_nationkey AS nation, count(*) AS scenes FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY 1),
r AS (SELECT n_nationkey AS nation, n_name AS name, r_name AS region, impression, exclusion, scenes,
CASE WHEN impression IS NOT NULL THEN 'impression' WHEN exclusion IS NOT NULL THEN 'excluded' WHEN coalesce(scenes, 0) > 0 THEN 'scanned' ELSE 'unknown' END AS status
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN i ON n_nationkey = i.nation LEFT JOIN x ON n_nationkey = x.nation LEFT JOIN sc ON n_nationkey = sc.nation)"""


def nodes(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    roster = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"), F.col("r_name").alias("region"))
    impressions = t("supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("impression"))
    excluded = t("customer").where("c_acctbal < -900").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("exclusion"))
    seen = t("customer").join(t("orders").where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("scenes"))
    return cards.relationship_nodes(roster, "nation", impressions, excluded, seen)


@Q(f"WITH {NODES} SELECT nation, name, region, impression, exclusion, scenes, status FROM r")
def relationship_nodes(spark, sf_dir):
    return nodes(spark, sf_dir).select("nation", "name", "region", "impression", "exclusion", "scenes", "status")


@Q(f"WITH {NODES} SELECT status, count(name) AS n FROM (VALUES ('impression'), ('excluded'), ('scanned'), ('unknown')) k(status) LEFT JOIN r USING (status) GROUP BY status")
def tier_counts(spark, sf_dir):
    known = spark.createDataFrame([(s,) for s in ("impression", "excluded", "scanned", "unknown")], "status string")
    return cards.counts_of_all(nodes(spark, sf_dir), "status", known)


@Q(f"WITH {NODES} SELECT r_name AS region, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE status = 'impression'), '') AS contacts FROM region LEFT JOIN r ON region = r_name GROUP BY r_name")
def region_contacts(spark, sf_dir):
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("region"))
    return cards.contacts_by_region(nodes(spark, sf_dir), "region", "name", F.col("status") == "impression", regions)


@Q("""SELECT l_orderkey AS card, l_returnflag AS mode, string_agg(o_orderpriority || '/' || l_linenumber, ';' ORDER BY l_linenumber, o_orderpriority) AS facts
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1, 2""")
def fact_modes(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("card"), F.col("l_returnflag").alias("mode"), "l_linenumber")
    facts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("card"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority"))
    out = cards.facts_by_mode(own.join(facts, "card").withColumn("fact", F.concat_ws("/", "priority", "l_linenumber")).where("priority is not null"), facts.select("card"), ["card"], "mode", "fact", "l_linenumber")
    return out.select("card", "mode", F.array_join("facts", ";").alias("facts"))


REVIEWS = """v AS (SELECT doc_id, text, CASE WHEN doc_id % 7 = 3 THEN 'revise' ELSE 'pass' END AS v1, CASE WHEN doc_id % 7 = 3 THEN CASE WHEN doc_id % 5 = 0 THEN 'revise' ELSE 'pass' END END AS v2,
CASE WHEN doc_id % 7 = 3 AND doc_id % 5 = 0 AND doc_id % 2 = 0 THEN 'pass' END AS v3 FROM documents)"""


def reviews(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    one = d.select("doc_id", F.when(F.col("doc_id") % 7 == 3, "revise").otherwise("pass").alias("verdict"), F.when(F.col("doc_id") % 7 == 3, F.substring("text", 1, 40)).alias("replacement"))
    two = d.where("doc_id % 7 = 3").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "revise").otherwise("pass").alias("verdict"), F.when(F.col("doc_id") % 5 == 0, F.substring("text", 1, 20)).alias("replacement"))
    three = d.where("doc_id % 7 = 3 and doc_id % 5 = 0 and doc_id % 2 = 0").select("doc_id", F.lit("pass").alias("verdict"), F.lit(None).cast("string").alias("replacement"))
    return d, one, two, three


@Q(f"WITH {REVIEWS} SELECT doc_id, sha256(CASE WHEN v2 = 'revise' THEN substr(text, 1, 20) ELSE text END) AS text_sha, coalesce(v2, 'not_in_round') AS verdict FROM v")
def review_apply(spark, sf_dir):
    d, _, two, _ = reviews(spark, sf_dir)
    return cards.apply_reviews(d, two, "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("text_sha"), "verdict")


@Q(f"""WITH {REVIEWS}, f AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN substr(text, 1, 5) WHEN v2 = 'revise' THEN substr(text, 1, 20) WHEN v1 = 'revise' THEN substr(text, 1, 40) ELSE text END AS final FROM v)
SELECT doc_id, CASE WHEN v1 = 'pass' THEN 'p' WHEN v2 = 'pass' THEN 'rp' WHEN v3 = 'pass' THEN 'rrp' ELSE 'rr-' END AS route,
CASE WHEN v2 = 'revise' AND v3 IS NULL THEN 'round 3 is missing' WHEN final <> CASE WHEN v2 = 'revise' THEN substr(text, 1, 20) WHEN v1 = 'revise' THEN substr(text, 1, 40) ELSE text END THEN 'text differs' END AS error FROM f""")
def review_lineage(spark, sf_dir):
    d, one, two, three = reviews(spark, sf_dir)
    n = F.col("doc_id")
    final = F.when(n % 11 == 0, F.substring("text", 1, 5)).when((n % 7 == 3) & (n % 5 == 0), F.substring("text", 1, 20)).when(n % 7 == 3, F.substring("text", 1, 40)).otherwise(F.col("text"))
    return cards.lineage(d.withColumn("final", final), "doc_id", "text", "final", [one, two, three])


@Q("""SELECT doc_id, unnest(list_filter([CASE WHEN trim(text) = '' THEN 'empty' END, CASE WHEN regexp_matches(text, '\\{[A-Z_]+(#[^}]*)?\\}|<[^>]{1,80}>') THEN 'markup' END,
CASE WHEN regexp_matches(text, '(^|\\n)#') THEN 'leading_hash' END, CASE WHEN contains(text, chr(65533)) THEN 'replacement_character' END, CASE WHEN regexp_matches(text, '[\\x00-\\x08\\x0B-\\x1F\\x7F]') THEN 'control_character' END,
CASE WHEN contains(text, '***') THEN 'stars' END], lambda x: x IS NOT NULL)) AS rule FROM documents""")
def clean_text_violations(spark, sf_dir):
    rules = [*checks.text_rules(F.col("text")), ("stars", F.contains("text", F.lit("***")))]
    return checks.violations(table(spark, sf_dir, "documents"), "doc_id", rules).select("doc_id", "rule")


@Q(r"""SELECT doc_id, pattern, hits FROM (SELECT doc_id, 'email' AS pattern, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+')) AS hits FROM documents
UNION ALL SELECT doc_id, 'home_path', len(regexp_extract_all(text, '/(home|Users)/[a-z]+')) FROM documents UNION ALL SELECT doc_id, 'api_key', len(regexp_extract_all(text, '\b(sk|AKIA)[A-Za-z0-9-]{16,}')) FROM documents) WHERE hits > 0""")
def private_scan(spark, sf_dir):
    return checks.private_hits(table(spark, sf_dir, "documents"), "doc_id", "text")


SFT = """p AS (SELECT conv_id, turn, role, text, lag(role) OVER w AS prole, lag(text) OVER w AS ptext FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


@Q(f"""WITH {SFT} SELECT conv_id, turn, unnest(list_filter([CASE WHEN ptext IS NULL THEN 'prompt_size' END, CASE WHEN prole IS DISTINCT FROM 'user' THEN 'prompt_roles' END, CASE WHEN role <> 'assistant' THEN 'completion_role' END], lambda x: x IS NOT NULL)) AS rule FROM p""")
def schema_violations(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    message = lambda r, c: F.struct(r.alias("role"), c.alias("content"))
    t = table(spark, sf_dir, "conversations").withColumns({"prole": F.lag("role").over(w), "ptext": F.lag("text").over(w)})
    system = message(F.lit("system"), F.lit("be kind"))
    rows = t.select(F.struct("conv_id", "turn").alias("key"), F.when(F.col("ptext").isNull(), F.array(system)).otherwise(F.array(system, message(F.col("prole"), F.col("ptext")))).alias("prompt"), message(F.col("role"), F.col("text")).alias("completion"))
    return checks.violations(rows, "key", checks.sft_rules()).select("key.conv_id", "key.turn", "rule")


@Q("""SELECT o_orderkey, sha256('{"custkey":' || o_custkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS hash FROM orders""")
def canonical_hash(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", T.canonical_hash(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).alias("hash"))


IDS = "i AS (SELECT DISTINCT CASE WHEN l_linenumber = 1 THEN l_suppkey::VARCHAR ELSE 'x' || l_suppkey END AS id FROM lineitem)"


@Q(f"WITH {IDS} SELECT id, row_number() OVER (ORDER BY CASE WHEN regexp_matches(id, '^[0-9]+$') THEN id::BIGINT ELSE 1000000000000 END, id) AS place FROM i")
def numeric_id_order(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") == 1, F.col("l_suppkey").cast("string")).otherwise(F.concat(F.lit("x"), "l_suppkey")).alias("id")).distinct()
    order = [F.when(F.col("id").rlike("^[0-9]+$"), F.col("id").cast("decimal(38,0)")).otherwise(F.lit("1" + "0" * 30).cast("decimal(38,0)")), F.col("id")]
    return numbered(ids, order, "place")


@Q("SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INT AS rank FROM lineitem) WHERE rank <= 8")
def top_n_per_key(spark, sf_dir):
    return retrieval.top_per_key(table(spark, sf_dir, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 8).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@Q("""WITH a AS (SELECT c.conv_id, turn, text, n_name AS card, n_nationkey % 3 AS tier, n_regionkey FROM conversations c JOIN nation ON n_nationkey = c.conv_id % 25 OR n_nationkey = c.turn WHERE role = 'assistant'),
r AS (SELECT conv_id, turn, card, CASE WHEN tier = 0 AND contains(text, 'the') THEN 1 WHEN tier = 1 AND length(text) > 300 THEN 2 WHEN n_regionkey = 2 THEN 3 END AS rule FROM a)
SELECT conv_id, turn, ['claims_acquaintance', 'exaggerated_familiarity', 'wrong_region'][min(rule)] AS rule, arg_min(card, (rule, card)) AS card FROM r WHERE rule IS NOT NULL GROUP BY 1, 2""")
def consistency_rules(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    # an answer's active cards: two key lookups, no pairs of all
    active = c.select("conv_id", "turn", "text", F.explode(F.array_distinct(F.array(F.col("conv_id") % 25, F.col("turn")))).alias("n_nationkey"))
    pairs = active.join(table(spark, sf_dir, "nation"), "n_nationkey").withColumn("tier", F.col("n_nationkey") % 3)
    rules = [("claims_acquaintance", (F.col("tier") == 0) & F.contains("text", F.lit("the"))), ("exaggerated_familiarity", (F.col("tier") == 1) & (F.length("text") > 300)), ("wrong_region", F.col("n_regionkey") == 2)]
    out = checks.first_conflicts(pairs.select(F.struct("conv_id", "turn").alias("answer"), F.col("n_name").alias("card"), "text", "tier", "n_regionkey"), "answer", rules)
    return out.select("answer.conv_id", "answer.turn", "rule", "card")


@Q("""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS cards FROM conversations)
SELECT conv_id, turn, coalesce(contains(text, 'the ') AND substr(cards, 3, 12) <> '' AND contains(cards, substr(cards, 3, 12)), false) AS grounded FROM p""")
def grounded_quotes(spark, sf_dir):
    from pyspark.sql import Window as W

    p = table(spark, sf_dir, "conversations").withColumn("cards", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")))
    p = p.withColumns({"quote": F.lit("the "), "card_quote": F.substring("cards", 3, 12)})
    return checks.grounded(p, "quote", "text", "card_quote", "cards").select("conv_id", "turn", "grounded")


@Q("""SELECT l_shipmode AS mode, n FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, count(*) AS n FROM lineitem GROUP BY 1)""")
def category_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("mode")).agg(F.count("*").alias("n"))


@Q("SELECT 'open' AS flag, count(*) FILTER (WHERE o_orderstatus = 'O') AS count FROM orders UNION ALL SELECT 'urgent', count(*) FILTER (WHERE o_orderpriority LIKE '1%') FROM orders UNION ALL SELECT 'never', 0 FROM (SELECT 1)")
def true_flags(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "O").alias("open"), F.startswith("o_orderpriority", F.lit("1")).alias("urgent"), F.lit(False).alias("never"))
    return quality.flag_counts(o, ["open", "urgent", "never"])


@Q("""SELECT o_orderpriority AS card, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'combat' ELSE 'profile' END AS voice_group,
CASE left(o_orderpriority, 1) WHEN '1' THEN 'attack' WHEN '2' THEN 'skill' WHEN '3' THEN 'about' WHEN '4' THEN 'greeting' ELSE 'other_profile' END AS voice_category, left(o_orderpriority, 1) IN ('3', '5') AS affinity, count(*) AS n FROM orders GROUP BY ALL""")
def rule_categories(spark, sf_dir):
    title = F.col("o_orderpriority")
    found = scenes.categorise(title, {"1": "attack", "2": "skill"}, [("prefix", ("3-MED",), "about"), ("set", ("4-NOT SPECIFIED",), "greeting")], ("greeting",))
    rows = table(spark, sf_dir, "orders").select(title.alias("card"), found.alias("c")).select("card", "c.*")
    return rows.groupBy("card", "voice_group", "voice_category", "affinity").agg(F.count("*").alias("n"))


@Q("""SELECT n_nationkey, 'impression and exclusion' AS problem FROM nation WHERE n_nationkey % 6 = 0 UNION ALL SELECT n_nationkey + 100, 'not in the roster' FROM nation WHERE n_nationkey % 5 = 0""")
def contradictions(spark, sf_dir):
    n, k = table(spark, sf_dir, "nation").select("n_nationkey"), F.col("n_nationkey")
    return cards.contradictions(n.where(k % 2 == 0).union(n.where(k % 5 == 0).select(k + 100)), n.where(k % 3 == 0), n, "n_nationkey")


@Q(f"""WITH o AS (SELECT o_orderstatus AS status, {row_sha("o_orderkey", "o_custkey", "o_orderpriority")} AS h, {row_sha("o_orderkey", "(o_custkey + (o_orderkey = (SELECT min(o_orderkey) FROM orders))::INT)", "o_orderpriority")} AS g FROM orders),
m AS (SELECT status, count(*) AS n, sum(CASE WHEN status = 'P' THEN 1 ELSE 0 END) + count(*) AS stated, sha256(count(*) || ',' || {ADDED}) AS found_sha, sha256(count(*) || ',' || {ADDED.replace("(h,", "(g,")}) AS stated_sha FROM o GROUP BY 1)
SELECT status, 'n' AS field, stated::VARCHAR AS stated, n::VARCHAR AS found FROM m WHERE stated <> n UNION ALL SELECT status, 'content', stated_sha, found_sha FROM m WHERE stated_sha <> found_sha""")
def manifest_check(spark, sf_dir):
    """A manifest whose count of one split is wrong, and whose contents differ from what is there by one field of one row."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), "o_orderkey", "o_custkey", "o_orderpriority")
    first = o.agg(F.min("o_orderkey").alias("first"))
    other = o.join(F.broadcast(first), F.lit(True)).withColumn("o_custkey", F.col("o_custkey") + (F.col("o_orderkey") == F.col("first")).cast("int"))
    sums = lambda rows: content.contents(rows, ["status"], ["o_orderkey", "o_custkey", "o_orderpriority"])
    actual = sums(o).select("status", "n", content.digest().alias("content"))
    stated = sums(other).select("status", (F.col("n") * F.when(F.col("status") == "P", 2).otherwise(1)).alias("n"), content.digest().alias("content"))
    return checks.manifest_mismatches(stated, actual, "status", ["n", "content"])


@Q("""WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, min(v) AS least, max(v) FILTER (WHERE rn = 1 + round_even((n - 1) * 0.1::DOUBLE, 0)) AS p10, max(v) FILTER (WHERE rn = 1 + round_even((n - 1) * 0.5::DOUBLE, 0)) AS p50, max(v) FILTER (WHERE rn = 1 + round_even((n - 1) * 0.99::DOUBLE, 0)) AS p99, max(v) AS largest, any_value(n) AS n FROM r GROUP BY 1""")
def price_percentiles(spark, sf_dir):
    return quality.refined_percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.99])


@Q("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def pending_inputs(spark, sf_dir):
    return checks.reusable(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", F.col("quality") == 1)


LRU = """t AS (SELECT user_id, event_type || ':' || (json_extract_string(props, '$.k')::BIGINT % 20) AS card, ts, event_id FROM events), l AS (SELECT user_id, card, max((ts, event_id)) AS last_at FROM t GROUP BY 1, 2)"""


@Q(f"WITH {LRU} SELECT user_id, string_agg(card, ',' ORDER BY rank) AS active FROM (SELECT user_id, card, row_number() OVER (PARTITION BY user_id ORDER BY last_at DESC) AS rank FROM l) WHERE rank <= 6 GROUP BY user_id")
def lru_stream(spark, sf_dir):
    return sessions.replayed_sets(spark, f"{sf_dir}/events.parquet", 6)


@Q("""WITH RECURSIVE o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, length(props) + length(event_type) AS size FROM events),
s(user_id, i, used, compactions) AS (SELECT user_id, i, CASE WHEN size >= 160 THEN 0 ELSE size END, CASE WHEN size >= 160 THEN 1 ELSE 0 END FROM o WHERE i = 1
UNION ALL SELECT o.user_id, o.i, CASE WHEN used + size >= 160 THEN 0 ELSE used + size END, compactions + CASE WHEN used + size >= 160 THEN 1 ELSE 0 END FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 1)
SELECT user_id, max(compactions)::BIGINT AS compactions FROM s GROUP BY user_id""")
def compaction_stream(spark, sf_dir):
    return sessions.replayed_compactions(spark, f"{sf_dir}/events.parquet", 200, 0.8)
