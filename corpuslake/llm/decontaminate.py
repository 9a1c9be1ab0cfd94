"""Benchmark contamination by a prefix-filtered set join on exact word windows. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslake.llm.common import ascii_lower, bounded_broadcast, fits, materialize, read, sha256_hex

WINDOW = 13
#: What stands between words, after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def row_key() -> dict[str, Column]:
    text = F.coalesce("text", F.lit(""))
    return {"k": F.xxhash64("doc_id", text), "j": F.hash(text, "doc_id")}


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """For every document (doc_id, text): doc_id, k, j, n_words, n_hit, n_items, items (ids as sorted strings) and contaminated.

    A window is `size` consecutive words of an item (item_id, text), or all of them where an item has fewer. A document
    word inside any occurrence of a window is hit; contaminated: at least one hit and a twentieth of all words.

    1. Texts become word arrays once. Counts of the items' words over all documents give the order by rarity.
    2. Containment must be whole, so a window's necessary prefix is one token: its rarest word. Windows whose rarest
       word no document has are gone.
    3. Only the positions of prefix tokens are looked at, each with the words around it: windows meet them by token, length and
       position bounds say whether the window fits around the token, and the words of that stretch are compared exactly.
    4. Hit words are the union of the stretches, by a running maximum of their ends within a document. A window's items
       are looked up after that, once for each document and window, so an item list never travels with the windows.

    Tokens and windows are broadcast only where a count proves them few. Otherwise positions travel alone (a key, a number
    and a word) to meet the tokens, and those that are left fetch their neighbourhood from their own text. Null texts have no words,
    items without words or id have no windows, rows equal in doc_id and text get equal results, as do repeated items.
    k and j identify a row's (doc_id, text).
    """
    listed = materialize(docs.select("doc_id", *(c.alias(n) for n, c in row_key().items()), words(F.col("text")).alias("words")).withColumn("n_words", F.size("words").cast("long")), "decon-words")
    own = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1))))
    cut = own.withColumn("at", starts).select("item", F.array_join(F.slice("w", F.col("at"), size), " ").alias("string"))
    windows = materialize(cut.select("string").distinct().select("string", F.split("string", " ").alias("w"), F.monotonically_increasing_id().alias("window")), "decon-windows")
    owners = materialize(cut.join(windows.select("string", "window"), "string").select("window", "item").distinct(), "decon-owners")

    vocabulary = materialize(windows.select(F.explode("w").alias("word")).distinct(), "decon-vocabulary")
    every = listed.select(F.explode("words").alias("word"))
    # beyond a broadcast, words are counted before they travel
    every = every.join(F.broadcast(vocabulary), "word") if fits(vocabulary) else every
    counts = every.groupBy("word").agg(F.count("*").alias("n"))
    counts = materialize(vocabulary.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n")), "decon-counts")
    placed = windows.select("window", F.posexplode("w").alias("off", "word")).join(counts, "word")
    rarest = placed.groupBy("window").agg(F.min(F.struct("n", "word", "off")).alias("r")).where("r.n > 0").select("window", F.col("r.word").alias("token"), F.col("r.off").alias("off"))
    windows = materialize(windows.join(rarest, "window").select("window", "string", F.size("w").alias("len"), "token", "off"), "decon-prefixes")
    tokens = materialize(windows.select("token").distinct(), "decon-tokens")
    longest = lambda df, c: df.select(F.max(F.octet_length(c))).first()[0] or 1

    near = F.slice("words", F.greatest(F.col("pos") - (size - 1), F.lit(0)) + 1, 2 * size - 1).alias("near")
    if fits(tokens, row_bytes=longest(tokens, "token") + 16):
        spots = listed.select("k", "j", "n_words", "words", F.posexplode("words").alias("pos", "token")).join(F.broadcast(tokens), "token").select("k", "j", "n_words", "pos", "token", near)
    else:
        alone = listed.select("k", "j", F.posexplode("words").alias("pos", "token")).join(tokens, "token")
        places = alone.groupBy("k", "j").agg(F.collect_set("pos").alias("places"))
        spots = listed.dropDuplicates(["k", "j"]).join(places, ["k", "j"]).select("k", "j", "n_words", "words", F.explode("places").alias("pos")).select("k", "j", "n_words", "pos", F.get("words", F.col("pos")).alias("token"), near)
    start = F.col("pos") - F.col("off")
    begin = F.greatest(F.col("pos") - (size - 1), F.lit(0))
    same = (start >= 0) & (start + F.col("len") <= F.col("n_words")) & (F.array_join(F.slice("near", F.greatest(start - begin, F.lit(0)) + 1, F.col("len")), " ") == F.col("string"))
    hits = spots.join(bounded_broadcast(windows, row_bytes=longest(windows, "string") + 64), "token").where(same).select("k", "j", start.alias("start"), (start + F.col("len")).alias("end"), "window")
    hits = materialize(hits, "decon-hits")
    before = F.max("end").over(W.partitionBy("k", "j").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))))
    covered = hits.select("k", "j", "start", "end").distinct().withColumn("new", new).groupBy("k", "j").agg(F.sum("new").alias("n_hit"))
    named = hits.select("k", "j", "window").distinct().join(owners, "window").select("k", "j", "item").distinct().groupBy("k", "j").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = covered.join(named, ["k", "j"])
    out = listed.select("doc_id", "k", "j", "n_words").join(found, ["k", "j"], "left")
    out = out.select("doc_id", "k", "j", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.select("doc_id", "k", "j", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by every benchmark item."""
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha256_hex(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


#: The same rows from SQL.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, s)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
