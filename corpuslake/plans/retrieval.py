"""Retrieval queries: benchmark items stand for cards, documents for scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.operators import activation, retrieval
from corpuslake.plans.registry import Registry, table

Q = Registry()
WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
LONG = "list_filter(" + WORDS.format("text") + ", lambda x: length(x) >= 9)"


def long_words(text: str = "text"):
    return F.filter(retrieval.word_terms(F.col(text)), lambda t: F.length(t) >= 9)


@Q(f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({LONG})) AS term FROM documents) GROUP BY term")
def doc_freq(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", long_words().alias("terms"))
    return retrieval.document_frequency(docs, "doc_id", "terms")


def _terms(spark, sf_dir):
    """An item's exact terms: its words of 12 characters or more."""
    words = F.array_distinct(F.filter(retrieval.word_terms(F.col("text")), lambda t: F.length(t) >= 12))
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(words).alias("term"))


SCORES = f"""n AS (SELECT count(*) AS total FROM documents),
t AS (SELECT DISTINCT item_id, unnest(list_filter({WORDS.format('text')}, lambda x: length(x) >= 12)) AS term FROM benchmark),
dw AS (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents),
x AS (SELECT item_id, doc_id, term, count(*) AS c FROM t JOIN dw USING (term) GROUP BY ALL),
base AS (SELECT item_id, doc_id, sum(18.0 + 3.0 * least(length(term), 16) + 4.0 * least(c, 4))::DOUBLE AS base FROM x GROUP BY 1, 2),
tp AS (SELECT doc_id, term, count(*) AS tf FROM dw WHERE length(term) >= 9 GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tp GROUP BY term),
qp AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({LONG}) AS term FROM benchmark) GROUP BY 1, 2),
sh AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY df, length(term) DESC, term) AS rank FROM qp JOIN df USING (term) JOIN tp USING (term) JOIN base USING (item_id, doc_id)),
ex AS (SELECT item_id, doc_id, sum((ln((total + 1.0) / (df + 1)) + 1) * (length(term) - 1) * least(qf, tf, 2) * 0.32 ORDER BY rank) AS extra FROM sh, n WHERE rank <= 80 AND df <= greatest(8, total // 5) GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, base + coalesce(extra, 0) AS score FROM base LEFT JOIN ex USING (item_id, doc_id))"""


def scores(spark, sf_dir, top=None):
    docs = table(spark, sf_dir, "documents")
    found = retrieval.word_matches(docs, "doc_id", "text", _terms(spark, sf_dir), "item_id", "term")
    exact = found.select("item_id", "doc_id", retrieval.term_score(F.length("term"), F.col("n"), F.lit(False)).alias("term_score"))
    items = table(spark, sf_dir, "benchmark").select("item_id", long_words().alias("terms"))
    return retrieval.lexical_scores(items, "item_id", docs.select("doc_id", long_words().alias("terms")), "doc_id", "terms", exact, top=top)


@Q(f"WITH {SCORES} SELECT item_id, doc_id, rank, round(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM s WHERE score >= 9) WHERE rank <= 8")
def lexical_retrieval(spark, sf_dir):
    top = retrieval.top_per_key(scores(spark, sf_dir, 8), ["item_id"], [F.desc(F.round("score", 6)), F.col("doc_id")], 8)
    return top.select("item_id", "doc_id", "rank", F.round("score", 3).alias("score"))


@Q("""WITH s AS (SELECT doc_id, unnest(range(1, len(l) + 1)) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
m AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER w AS i, max((length(line) >= 400)::INT) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS kept FROM m WHERE n <= 12 OR near = 1 OR i <= 2 OR i > n - 1) WHERE kept <= 12""")
def retained_windows(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))
    return retrieval.retained(lines, "doc_id", "pos", F.length("line") >= 400, window=2, cap=12, head=2, tail=1).select("doc_id", "pos")


GAZETTEER = f"g AS (SELECT DISTINCT item_id AS entity, list_aggregate({WORDS.format('text')}[3:4], 'string_agg', ' ') AS alias FROM benchmark UNION SELECT item_id, {WORDS.format('text')}[6] FROM benchmark)"
MATCHES = f"""{GAZETTEER}, dw AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw),
m AS (SELECT doc_id, entity, alias, count(*) AS n FROM p JOIN g ON string_split(alias, ' ')[1] = w[i] AND (NOT contains(alias, ' ') OR string_split(alias, ' ')[2] = w[i + 1]) GROUP BY ALL)"""


def gazetteer(spark, sf_dir):
    w = retrieval.word_terms(F.col("text"))
    both = F.array(F.array_join(F.slice(w, 3, 2), " "), F.get(w, F.lit(5)))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entity"), F.explode(both).alias("alias")).where("alias is not null").distinct()


def matches(spark, sf_dir):
    return retrieval.word_matches(table(spark, sf_dir, "documents"), "doc_id", "text", gazetteer(spark, sf_dir), "entity", "alias")


@Q(f"WITH {MATCHES} SELECT doc_id, entity, alias, n FROM m")
def alias_join(spark, sf_dir):
    return matches(spark, sf_dir)


@Q(f"WITH {MATCHES} SELECT entity, count(DISTINCT doc_id) AS n_docs, sum(n)::BIGINT AS n_mentions FROM m GROUP BY entity")
def alias_stats(spark, sf_dir):
    return matches(spark, sf_dir).groupBy("entity").agg(F.count_distinct("doc_id").alias("n_docs"), F.sum("n").alias("n_mentions"))


@Q(f"WITH {GAZETTEER} SELECT lower(alias) AS alias, string_agg(entity::VARCHAR, ',' ORDER BY entity) AS owners, count(*) > 1 AS ambiguous FROM g WHERE alias IS NOT NULL GROUP BY 1")
def alias_index(spark, sf_dir):
    out = retrieval.alias_index(gazetteer(spark, sf_dir), "entity", "alias")
    return out.select("alias", F.array_join(F.transform("owners", lambda x: x.cast("string")), ",").alias("owners"), "ambiguous")


@Q(f"WITH {GAZETTEER} SELECT lower(alias) AS alias, count(DISTINCT entity) AS n_owners FROM g WHERE alias IS NOT NULL GROUP BY 1 HAVING count(DISTINCT entity) > 1")
def alias_collisions(spark, sf_dir):
    from corpuslake.operators.cards import collisions

    return collisions(gazetteer(spark, sf_dir), "alias", "entity")


@Q(f"""WITH {MATCHES}, b AS (SELECT doc_id, entity, arg_min(alias, (-strlen(alias), alias)) AS alias FROM m GROUP BY 1, 2)
SELECT doc_id, entity, alias FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.doc_id = b.doc_id AND o.entity <> b.entity AND strlen(o.alias) > strlen(b.alias) AND contains(o.alias, b.alias))""")
def shadowed_matches(spark, sf_dir):
    return activation.longest_matches(matches(spark, sf_dir), "doc_id", "entity", "alias")


EVIDENCE = """e(entity, alias) AS (VALUES (1, 'user'), (2, 'system'), (3, 'the'), (3, 'user'))"""


@Q(f"""WITH {EVIDENCE}, l AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
x AS (SELECT conv_id, entity, 4 AS score, 'speaks' AS reason FROM l JOIN e ON lower(role) = alias
UNION ALL SELECT conv_id, entity, 20, 'named' FROM (SELECT DISTINCT conv_id, turn, entity FROM l JOIN e ON role = 'assistant' AND list_contains({WORDS.format('text')}, alias))
UNION ALL SELECT conv_id, entity, 12, 'meets' FROM l JOIN e ON nxt IS NOT NULL AND (role = 'assistant') <> (nxt = 'assistant') AND lower(CASE WHEN role = 'assistant' THEN nxt ELSE role END) = alias)
SELECT conv_id, entity, sum(score)::BIGINT AS score, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM x GROUP BY 1, 2""")
def scene_evidence(spark, sf_dir):
    entities = spark.createDataFrame([(1, "user"), (2, "system"), (3, "the"), (3, "user")], "entity int, alias string")
    turns = table(spark, sf_dir, "conversations").withColumn("branch", F.lit(""))
    out = retrieval.scene_evidence(turns, "conv_id", "turn", "branch", "role", "text", "assistant", entities, "entity", "alias")
    return out.select("conv_id", "entity", "score", F.array_join("reasons", ",").alias("reasons"))
