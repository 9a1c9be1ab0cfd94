"""Corpus queries: normalise, deduplicate, align, label, split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.functions import text as T
from corpuslake.operators import align, dedup, quality, split
from corpuslake.operators.tables import settled
from corpuslake.plans.registry import Registry, table

Q = Registry()
SQUASH = f"trim(regexp_replace(text, '{T.BLANK}+', ' ', 'g'))"
KEYED = f"d AS (SELECT *, sha256({SQUASH}) AS text_key FROM documents)"
SEMANTIC = "length(regexp_replace(text, '[^0-9A-Za-z\\x{3400}-\\x{9FFF}]', '', 'g'))"
SEED, VALIDATION, TEST = "corpus-1", 0.1, 0.1


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("text_key", T.text_key(F.col("text")))


@Q(f"WITH {KEYED} SELECT text_key, min(doc_id) AS doc_id, count(*) AS text_occurrence_count FROM d GROUP BY text_key")
def norm_text_dedup(spark, sf_dir):
    return dedup.unique_texts(docs(spark, sf_dir), "text_key", "doc_id")


@Q(f"WITH {KEYED} SELECT doc_id, first_doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text_key) AS first_doc_id FROM d) WHERE doc_id <> first_doc_id")
def norm_text_copies(spark, sf_dir):
    return dedup.copies_of(docs(spark, sf_dir).select("doc_id", "text_key"), "text_key", "doc_id").select("doc_id", "first_doc_id")


@Q(f"""WITH {KEYED}, r AS (SELECT *, row_number() OVER (PARTITION BY text_key ORDER BY CASE source WHEN 'src0' THEN 0 WHEN 'src1' THEN 1 ELSE 9 END, length(source), source, doc_id) AS rn FROM d),
g AS (SELECT text_key, count(*) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS s FROM d GROUP BY text_key)
SELECT doc_id, source, s AS sources, n AS source_occurrence_count FROM r JOIN g USING (text_key) WHERE rn = 1""")
def canonical_pick(spark, sf_dir):
    priority = F.when(F.col("source") == "src0", 0).when(F.col("source") == "src1", 1).otherwise(9)
    rows = docs(spark, sf_dir).select("text_key", "doc_id", "source")
    out = dedup.canonical(rows, "text_key", [priority, F.length("source"), F.col("source"), F.col("doc_id")], "source")
    return out.select("doc_id", "source", F.array_join("duplicate_sources", ",").alias("sources"), "source_occurrence_count")


@Q(f"WITH {KEYED} SELECT text_key, count(DISTINCT lang) AS n_lang, count(DISTINCT source) AS n_source FROM d GROUP BY text_key HAVING count(DISTINCT lang) > 1 OR count(DISTINCT source) > 1")
def dedup_conflicts(spark, sf_dir):
    return dedup.conflicts(docs(spark, sf_dir), "text_key", "lang", "source")


APPEND = f"""WITH {KEYED}, base AS (SELECT * FROM d WHERE doc_id % 2 = 0),
fresh AS (SELECT text_key, min(doc_id) AS doc_id FROM d WHERE doc_id % 2 = 1 AND text_key NOT IN (SELECT text_key FROM base) GROUP BY text_key)"""


def _append(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "text_key")
    return dedup.append_new(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), "text_key", "doc_id")


@Q(APPEND + " SELECT doc_id FROM base UNION ALL SELECT doc_id FROM fresh")
def anti_append(spark, sf_dir):
    return _append(spark, sf_dir)[0].select("doc_id")


@Q(APPEND + " SELECT doc_id FROM d WHERE doc_id % 2 = 1 AND doc_id NOT IN (SELECT doc_id FROM fresh)")
def anti_append_skipped(spark, sf_dir):
    return _append(spark, sf_dir)[1].select("doc_id")


def _aligned(spark, sf_dir):
    return align.aligned(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id", "document", "label")


@Q("SELECT doc_id, d.lang, l.quality, l.toxic, CASE WHEN l.doc_id IS NULL THEN 'left' WHEN d.doc_id IS NULL THEN 'right' ELSE 'both' END AS side FROM documents d FULL JOIN labels l USING (doc_id)")
def align_full(spark, sf_dir):
    return _aligned(spark, sf_dir).select("doc_id", "document.lang", "label.quality", "label.toxic", "side")


@Q("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def align_left_only(spark, sf_dir):
    return _aligned(spark, sf_dir).where("side = 'left'").select("doc_id", "document.lang")


@Q("SELECT l.doc_id, l.quality FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def align_right_only(spark, sf_dir):
    english = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "lang")
    return align.aligned(english, table(spark, sf_dir, "labels"), "doc_id", "document", "label").where("side = 'right'").select("doc_id", "label.quality")


@Q("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)")
def semi_candidates(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return align.accepted(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), good, "doc_id")


RULES = [("toxic", "toxic = 1"), ("low_quality", "quality = 0"), ("too_short", f"{SEMANTIC} < 700"), ("too_long", f"{SEMANTIC} > 6000"), ("fragment_ending", "regexp_matches(rtrim(text), '(…|——|—)$')")]
REASONS = "r AS (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in RULES) + "], lambda x: x IS NOT NULL) AS reasons FROM documents LEFT JOIN labels USING (doc_id))"


def _reasons(spark, sf_dir):
    # what the rules need of a text is measured once, and only that meets the labels
    measured = table(spark, sf_dir, "documents").select("doc_id", T.semantic_length(F.col("text")).alias("n"), T.fragment_ending(F.col("text")).alias("fragment"))
    rows, n = measured.join(table(spark, sf_dir, "labels"), "doc_id", "left"), F.col("n")
    rules = [("toxic", F.col("toxic") == 1), ("low_quality", F.col("quality") == 0), ("too_short", n < 700), ("too_long", n > 6000), ("fragment_ending", F.col("fragment"))]
    return rows.select("doc_id", quality.all_reasons(rules).alias("reasons"), quality.first_reason(rules).alias("reason"))


@Q(f"WITH {REASONS} SELECT doc_id, array_to_string(reasons, ',') AS reasons, reasons[1] AS reason FROM r")
def exclusion_reasons(spark, sf_dir):
    return _reasons(spark, sf_dir).select("doc_id", F.array_join("reasons", ",").alias("reasons"), "reason")


@Q(f"WITH {REASONS} SELECT coalesce(reasons[1], 'kept') AS reason, count(*) AS n FROM r GROUP BY 1")
def exclusion_counts(spark, sf_dir):
    return _reasons(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


FLAGS = f"""f AS (SELECT doc_id, list_filter([CASE WHEN {SEMANTIC} <= 500 THEN 'le500' WHEN {SEMANTIC} <= 900 THEN 'le900' WHEN {SEMANTIC} <= 1400 THEN 'le1400' END,
CASE WHEN text LIKE '%###%' THEN 'symbols' END, CASE WHEN regexp_matches(text, '[0-9]{{5,}}') THEN 'long_number' END, CASE WHEN contains(text, 'é') OR contains(text, 'ü') THEN 'accents' END], lambda x: x IS NOT NULL) AS labels FROM documents)"""


def _flags(spark, sf_dir):
    """doc_id and a column for each flag, and their names. A text is measured once, before the rules, as each rule would evaluate its own copy."""
    text = F.col("text")
    measured = table(spark, sf_dir, "documents").select("doc_id", T.semantic_length(text).alias("n"), F.contains(text, F.lit("###")).alias("symbols"), text.rlike("[0-9]{5,}").alias("long_number"), T.any_of(text, ("é", "ü")).alias("accents"))
    rules = quality.ladder(F.col("n"), [("le500", 500), ("le900", 900), ("le1400", 1400)]) + [(name, F.col(name)) for name in ("symbols", "long_number", "accents")]
    return measured.select("doc_id", *(test.alias(name) for name, test in rules)), [name for name, _ in rules]


@Q(f"WITH {FLAGS} SELECT doc_id, array_to_string(labels, ',') AS labels FROM f")
def triage_flags(spark, sf_dir):
    rows, names = _flags(spark, sf_dir)
    return rows.select("doc_id", F.array_join(quality.all_reasons([(name, F.col(name)) for name in names]), ",").alias("labels"))


@Q(f"WITH {FLAGS} SELECT label, count(*) AS count FROM (SELECT unnest(labels) AS label FROM f) GROUP BY label")
def flag_counts(spark, sf_dir):
    return quality.flag_counts(*_flags(spark, sf_dir), "label").where("count > 0")


@Q("""WITH r AS (SELECT lang, length(text) AS len, row_number() OVER (PARTITION BY lang ORDER BY length(text)) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, min(len) AS least, max(len) AS largest, any_value(n) AS n, max(len) FILTER (WHERE rn = 1 + round_even((n - 1) * 0.5::DOUBLE, 0)) AS p50, max(len) FILTER (WHERE rn = 1 + round_even((n - 1) * 0.9::DOUBLE, 0)) AS p90, max(len) FILTER (WHERE rn = 1 + round_even((n - 1) * 0.99::DOUBLE, 0)) AS p99 FROM r GROUP BY lang""")
def length_percentiles(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.length("text").cast("long").alias("len"))
    return quality.nearest_percentiles(rows, ["lang"], "len", [0.5, 0.9, 0.99])


@Q(f"WITH {KEYED}, c AS (SELECT count(*) AS n FROM d GROUP BY text_key HAVING count(*) > 1) SELECT count(*) AS repeated_texts, coalesce(sum(n), 0)::BIGINT AS repeated_rows FROM c")
def exact_dup_summary(spark, sf_dir):
    return dedup.occurrence_summary(docs(spark, sf_dir), "text_key")


@Q(f"WITH {KEYED}, c AS (SELECT count(*) AS copies FROM d GROUP BY text_key) SELECT copies, count(*) AS texts FROM c GROUP BY copies")
def dup_distribution(spark, sf_dir):
    return dedup.occurrence_histogram(docs(spark, sf_dir), "text_key")


GROUPED = f"""g AS (SELECT doc_id, text, 'scene:' || source || ':' || (doc_id // 5) AS gid, CASE WHEN {SEMANTIC} >= 8 THEN sha256({SQUASH}) END AS text_key FROM documents),
e AS (SELECT DISTINCT a.gid AS x, b.gid AS y FROM g a JOIN g b ON a.text_key = b.text_key),
reach(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
comp AS (SELECT gid, coalesce(min(y), gid) AS component FROM (SELECT DISTINCT gid FROM g) LEFT JOIN reach ON gid = x GROUP BY gid)"""
SHARE = f"(('0x' || substr(sha256('{SEED}' || chr(0) || {{}}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"


def _split_sql(key: str) -> str:
    s = SHARE.format(key)
    return f"CASE WHEN {s} < {TEST} THEN 'test' WHEN {s} < {VALIDATION + TEST} THEN 'validation' ELSE 'train' END"


def grouped(spark, sf_dir):
    """doc_id, length, group and key of each text, written once: the loop and the joins after it never hash a text again."""
    rows = table(spark, sf_dir, "documents")
    return settled(rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), split.group_key(F.col("source"), F.floor(F.col("doc_id") / 5)).alias("gid"), F.when(T.substantive(F.col("text")), T.text_key(F.col("text"))).alias("text_key")), "grouped")


def _leakfree(spark, sf_dir):
    return split.leakfree_split(grouped(spark, sf_dir), "gid", "text_key", SEED, VALIDATION, TEST)


@Q(f"WITH RECURSIVE {GROUPED} SELECT gid, component FROM comp")
def dup_components(spark, sf_dir):
    return split.linked_groups(grouped(spark, sf_dir), "gid", "text_key")


@Q(f"WITH RECURSIVE {GROUPED} SELECT doc_id, gid, component, {_split_sql('component')} AS split FROM g JOIN comp USING (gid)")
def leakfree_split(spark, sf_dir):
    return _leakfree(spark, sf_dir).select("doc_id", "gid", "component", "split")


@Q(f"WITH RECURSIVE {GROUPED}, s AS (SELECT text_key, {_split_sql('component')} AS split FROM g JOIN comp USING (gid)) SELECT count(*) AS leaked_texts FROM (SELECT text_key FROM s WHERE text_key IS NOT NULL GROUP BY text_key HAVING count(DISTINCT split) > 1)")
def split_leakage(spark, sf_dir):
    return split.leaks(_leakfree(spark, sf_dir), "text_key").agg(F.count("*").alias("leaked_texts"))


@Q(f"WITH RECURSIVE {GROUPED}, s AS (SELECT text_key, {_split_sql('gid')} AS split FROM g) SELECT text_key, count(DISTINCT split) AS splits, count(*) AS n_rows FROM s WHERE text_key IS NOT NULL GROUP BY text_key HAVING count(DISTINCT split) > 1")
def naive_split_leakage(spark, sf_dir):
    rows = grouped(spark, sf_dir).withColumn("split", T.hash_split(F.col("gid"), SEED, VALIDATION, TEST))
    return split.leaks(rows, "text_key")


@Q(f"WITH RECURSIVE {GROUPED} SELECT {_split_sql('component')} AS split, count(*) AS n_rows, count(DISTINCT gid) AS n_groups, sum(length(text))::BIGINT AS n_chars FROM g JOIN comp USING (gid) GROUP BY 1")
def split_manifest(spark, sf_dir):
    return split.manifest(_leakfree(spark, sf_dir), "split", "gid", F.col("n_chars"))
