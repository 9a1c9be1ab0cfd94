"""Queries over text functions, reports and bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.functions import text as T
from corpuslake.operators import dialogue, quality, reports, retrieval
from corpuslake.plans.corpus import SEMANTIC
from corpuslake.plans.registry import Registry, table

Q = Registry()
MARKED = "'##' || text || '{NICKNAME} {M#he}{F#she}{RUBY#[D]x} {F#it}  ' || chr(10) || chr(10) || chr(10) || chr(10) || '#end'"


@Q(f"""SELECT item_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace({MARKED}, '(?m)^#+', '', 'g'), '{{NICKNAME}}', 'Traveler'),
'\\{{M#([^{{}}]*)\\}}\\{{F#([^{{}}]*)\\}}', '\\2', 'g'), '\\{{RUBY#\\[[DS]\\][^{{}}]*\\}}', '', 'g'), '\\{{[MF]#([^{{}}]*)\\}}', '\\1', 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM benchmark""")
def markup_resolved(spark, sf_dir):
    marked = F.concat(F.lit("##"), "text", F.lit("{NICKNAME} {M#he}{F#she}{RUBY#[D]x} {F#it}  \n\n\n\n#end"))
    return table(spark, sf_dir, "benchmark").select("item_id", T.resolve_markup(marked, "Traveler").alias("text"))


@Q("""WITH r AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS run FROM benchmark), g AS (SELECT item_id, unnest(range(1, length(run) - w + 2)) AS i, run, w FROM r, (VALUES (2), (3), (4)) v(w) WHERE length(run) >= w)
SELECT gram, count(DISTINCT item_id) AS df, count(*) AS tf FROM (SELECT item_id, substr(run, i, w) AS gram FROM g) GROUP BY gram""")
def gram_frequency(spark, sf_dir):
    grams = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.ngrams(F.lower("text"), "[a-z]+")).alias("gram"))
    return grams.groupBy("gram").agg(F.count_distinct("item_id").alias("df"), F.count("*").alias("tf"))


@Q(f"SELECT doc_id, {SEMANTIC} AS semantic, {SEMANTIC} >= 8 AS substantive FROM documents")
def semantic_lengths(spark, sf_dir):
    n = T.semantic_length(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("semantic"), T.substantive(F.col("text")).alias("substantive"))


@Q("""WITH p AS (SELECT conv_id % 3 AS split, role, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)
SELECT split, sum(before)::BIGINT AS prompt_chars, sum(length(text))::BIGINT AS completion_chars FROM p WHERE role = 'assistant' GROUP BY split""")
def character_totals(spark, sf_dir):
    """Answers as completions, up to four turns before each as its prompt."""
    rows = dialogue.rolling_context(table(spark, sf_dir, "conversations"), "conv_id", "turn", ["role", "text"], 4).where("role = 'assistant'")
    prompt = F.transform("context_before", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    return reports.character_totals(rows.select((F.col("conv_id") % 3).alias("split"), prompt.alias("prompt"), F.struct(F.col("text").alias("content")).alias("completion")), "split")


@Q("SELECT count(*) AS source_ids, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS covered_ids, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)) AS excluded_ids FROM documents")
def source_coverage(spark, sf_dir):
    used = table(spark, sf_dir, "labels").where("quality = 1").select(F.array("doc_id").alias("ids"))
    return reports.coverage(table(spark, sf_dir, "documents"), "doc_id", used, "ids")


@Q("""WITH r AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'revise' ELSE 'pass' END AS verdict, text, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 50) ELSE text END AS after FROM documents)
SELECT verdict, count(*) AS n, sum(length(text))::BIGINT AS chars_before, sum(length(after))::BIGINT AS chars_after FROM r GROUP BY verdict""")
def verdict_report(spark, sf_dir):
    revise = F.col("doc_id") % 3 == 0
    rows = table(spark, sf_dir, "documents").select(F.when(revise, "revise").otherwise("pass").alias("verdict"), "text", F.when(revise, F.substring("text", 1, 50)).otherwise(F.col("text")).alias("after"), F.array().cast("array<struct<issue_type:string>>").alias("issues"))
    return reports.verdict_report(rows, "text", "after")[0]


@Q("""WITH i AS (SELECT unnest(list_filter([CASE WHEN length(text) > 2000 THEN 'long' END, CASE WHEN contains(text, chr(10)) THEN 'lines' END, CASE WHEN lang <> 'en' THEN 'language' END], lambda x: x IS NOT NULL)) AS issue_type FROM documents)
SELECT issue_type, count(*) AS count FROM i GROUP BY 1""")
def verdict_issues(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    found = quality.all_reasons([("long", F.length("text") > 2000), ("lines", F.contains("text", F.lit("\n"))), ("language", F.col("lang") != "en")])
    rows = d.select(F.when(F.size(found) > 0, "revise").otherwise("pass").alias("verdict"), "text", F.transform(found, lambda x: F.struct(x.alias("issue_type"))).alias("issues"))
    return reports.verdict_report(rows, "text", "text")[1]


@Q("""SELECT n_nationkey AS nation, count(s_suppkey) AS n_suppliers, coalesce(string_agg(s_name, ',' ORDER BY s_name), '') AS suppliers,
sha256('{"suppliers":[' || coalesce(string_agg('{"s_name":"' || s_name || '"}', ',' ORDER BY s_name), '') || ']}') AS bundle_sha256 FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def evidence_bundles(spark, sf_dir):
    keys = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    parts = {"suppliers": (table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "nation"), ["s_name"])}
    out = reports.bundles(keys, "nation", parts)
    return out.select("nation", F.col("n_suppliers").cast("long").alias("n_suppliers"), F.array_join(F.transform("suppliers", lambda s: s["s_name"]), ",").alias("suppliers"), "bundle_sha256")


@Q("""WITH b AS (SELECT DISTINCT lang FROM documents WHERE doc_id % 10 = 0), v AS (SELECT count(*) AS base FROM documents WHERE doc_id % 10 = 0)
SELECT 'tenth' AS variant, base, count(*) FILTER (WHERE lang NOT IN (SELECT lang FROM b)) AS added, count(*) FILTER (WHERE lang IN (SELECT lang FROM b)) AS skipped, base + count(*) FILTER (WHERE lang NOT IN (SELECT lang FROM b)) AS combined
FROM documents, v WHERE doc_id % 10 <> 0 GROUP BY base""")
def variant_overlap(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return reports.variant_overlap({"tenth": (d.where("doc_id % 10 = 0"), d.where("doc_id % 10 <> 0"))}, "lang")


@Q("""WITH t(place, tier) AS (VALUES (1, 'close'), (2, 'familiar'), (3, 'none'), (4, 'empty'))
SELECT place, tier, coalesce(string_agg(n_name, '、' ORDER BY n_name), '') AS names FROM t LEFT JOIN nation ON tier = CASE WHEN n_nationkey < 5 THEN 'close' WHEN n_nationkey < 12 THEN 'familiar' ELSE 'none' END GROUP BY 1, 2""")
def tier_names(spark, sf_dir):
    n = F.col("n_nationkey")
    cards = table(spark, sf_dir, "nation").withColumn("tier", F.when(n < 5, "close").when(n < 12, "familiar").otherwise("none"))
    tiers = spark.createDataFrame([(1, "close"), (2, "familiar"), (3, "none"), (4, "empty")], "place int, tier string")
    return reports.names_by_tier(cards, "tier", "n_name", tiers, "place")


@Q("""WITH e AS (SELECT o_orderkey AS key, 4 AS expected FROM orders), f AS (SELECT l_orderkey AS key, count(*) AS found FROM lineitem GROUP BY 1)
SELECT key, coalesce(expected, 0)::BIGINT AS expected, coalesce(found, 0) AS found FROM e FULL JOIN f USING (key) WHERE coalesce(expected, 0) <> coalesce(found, 0)""")
def target_reconciliation(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit(4).alias("n"))
    return reports.reconciled(raw, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


@Q("""WITH a AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS card FROM conversations WHERE role = 'assistant'),
u AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(prev), '[\\p{L}\\p{N}]+'))) AS card FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) WHERE role = 'assistant' AND prev IS NOT NULL),
c AS (SELECT conv_id, turn, card FROM a UNION SELECT conv_id, turn, card FROM u)
SELECT conv_id, turn, string_agg(card, ',' ORDER BY card) AS cards FROM c WHERE card IN ('the', 'der', 'les', 'por', 'and') AND card <> 'and' GROUP BY 1, 2""")
def answer_cards(spark, sf_dir):
    from pyspark.sql import Window as W

    t = table(spark, sf_dir, "conversations").withColumn("prev", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant'")
    t = t.withColumn("answer", F.concat_ws(":", "conv_id", "turn"))
    names = spark.createDataFrame([(x, x) for x in ("the", "der", "les", "por", "and")], "card string, alias string")
    named = retrieval.word_matches(t, "answer", "text", names, "card", "alias").select("answer", "card")
    touched = retrieval.word_matches(t.where("prev is not null"), "answer", "prev", names, "card", "alias").select("answer", "card")
    both = named.union(touched).distinct().where("card <> 'and'").groupBy("answer").agg(F.array_join(F.array_sort(F.collect_list("card")), ",").alias("cards"))
    return t.select("conv_id", "turn", "answer").join(both, "answer").select("conv_id", "turn", "cards")


@Q("SELECT role, min(length(text)) AS least, max(length(text)) AS largest, count(*)::BIGINT AS n, quantile_disc(length(text), 0) AS p0, quantile_disc(length(text), 1) AS p100 FROM conversations GROUP BY role")
def role_lengths(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("role", F.length("text").cast("long").alias("len"))
    return quality.nearest_percentiles(rows, ["role"], "len", [0.0, 1.0])
