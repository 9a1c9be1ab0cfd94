"""How far the sources of a language diverge in the words they use, from bitmaps of terms by count."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslake.llm.common import bounded_broadcast, discard, materialize, read
from corpuslake.llm.textkit import slices
from corpuslake.operators.tables import numbered

#: Probabilities are whole numbers of this many parts.
PARTS = 1_000_000_000
#: Terms of one bitmap shard, distinct terms that a task counts before it hands them on, and cells of one block of ANDs.
SHARD, HELD, CELLS = 8192, 300_000, 1 << 22
TERM = re.compile(rb"[a-z\x80-\xff]+")


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of every group, and one row without a term (n 0) for the group itself.

    Tasks count while they read, so a hot group or term sends a row for each task and no text moves."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs, held = defaultdict(Counter), defaultdict(Counter), 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in n.items():
                seen, names = docs[lang, source], list(terms)
                size = len(names) + 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * size), pa.array([source] * size), pa.array([*(t.decode() for t in names), None], pa.string()), pa.array([*terms.values(), 0], pa.int64()), pa.array([*(seen[t] for t in names), 0], pa.int64()),
                ], names=["lang", "source", "term", "n", "docs"])

        for batch in slices(batches, "text"):
            for text, lang, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                # A-Z are the only letters that bytes.lower() knows, and every byte of another letter is 0x80 or more
                found = TERM.findall(text.encode().lower())
                key = (lang, source)
                held -= len(n[key])
                n[key].update(found)
                docs[key].update(set(found))
                held += len(n[key])
            if held > HELD:
                yield from rows()
                n, docs, held = defaultdict(Counter), defaultdict(Counter), 0
        yield from rows()

    part = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    return part.mapInArrow(count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(PARTS * (n + 1) / (total + terms)); decimals, as PARTS times a count leaves 64 bits."""
    return F.lit(1).cast("long") + F.call_function("div", F.lit(PARTS).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + terms).cast("decimal(20,0)"))


def surplus(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def joint_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard of one language: for every ordered pair of sources the sum of f over the shard's terms.

    rows: source, word (of 64 terms), p and bits (the terms of that word that have this p in this source); word -1 gives a source's p of
    count 0. A source's terms of count 0 are the complement of its bitmaps. ANDs of all bitmaps of a word and their popcounts are
    the pairs' joint cells, each of which counts f(p, q) once for every term in it."""
    zero = rows[rows["word"] < 0].sort_values("source")
    names = zero["source"].to_numpy()
    place = {s: i for i, s in enumerate(names)}
    none, sums = zero["p"].to_numpy(np.int64), np.zeros((len(names), len(names)), np.int64)
    rows = rows[rows["word"] >= 0]
    words, source, p, bits = rows["word"].to_numpy(), rows["source"].map(place).to_numpy(), rows["p"].to_numpy(np.int64), rows["bits"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(words[order])) + 1):
        own = np.zeros(len(names), np.uint64)
        np.bitwise_or.at(own, source[at], bits[at])
        rest = np.bitwise_or.reduce(own) & ~own
        left = np.flatnonzero(rest)
        s, v, b = np.concatenate([source[at], left]), np.concatenate([p[at], none[left]]), np.concatenate([bits[at], rest[left]])
        step = max(1, CELLS // len(b))
        for i in range(0, len(b), step):
            joint = np.bitwise_count(b[i : i + step, None] & b[None, :])
            x, y = np.nonzero(joint)
            gap = v[x + i] - v[y]
            np.add.at(sums, (s[x + i], s[y]), joint[x, y].astype(np.int64) * (gap * gap // v[y]))
    x, y = np.nonzero(~np.eye(len(names), dtype=bool))
    return pd.DataFrame({"source": names[x], "item": names[y], "value": sums[x, y]})


def divergence(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """How each (lang, source) group differs from the other sources of its language, and by which terms.

    docs: text, lang and source (null: ''). Terms are runs of letters (a-z and all of non-ASCII, only A-Z lower-cased); a language keeps those in
    at least `least` of its documents (rows). A group's p of a kept term is 1 + floor(1e9 * (count + 1) / (all its kept occurrences + kept
    terms)), and f(p, q) = floor((p - q)**2 / q). Returns lang, source, part, item, value and rank (value descending, item ascending):

    * pair: item is every other source of the language, value the sum of f(p, its q) over all kept terms; 0 where none is kept;
    * term: item is each of the `top` kept terms that the group has and uses more than the language does (q), value their f.

    Kept terms are numbered by frequency, so that the 64 terms of a bitmap word share few counts; bitmaps are stored by (lang, source,
    count, word) and dealt out in shards of SHARD terms, of which a task sees one at a time. Repeated rows count each; documents without text
    still make their group; an empty table gives no rows. The result has a row for every ordered pair of sources of a
    language, as is asked for; nothing else grows with the square of anything."""
    counts = materialize(term_counts(docs), "divergence-counts")
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("all_docs")).where(F.col("all_docs") >= least)
    kept = materialize(numbered(terms.select("lang", "term", "all_n"), [F.col("lang"), F.desc("all_n"), F.col("term")], "id"), "divergence-kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n"))
    used = materialize(counts.where("term is not null").join(kept, ["lang", "term"]).select("lang", "source", "term", "id", "n", "all_n"), "divergence-used")
    groups = counts.where("term is null").select("lang", "source").join(used.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    zero = F.lit(0).cast("long")
    groups = materialize(groups.join(langs, "lang", "left").select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "v", "lang_n"))), "divergence-groups")
    discard(counts)
    small = bounded_broadcast(groups)

    word = F.shiftright("id", 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("id") % 64).cast("int"))
    maps = used.groupBy("lang", "source", word.alias("word"), "n").agg(F.bit_or(bit).alias("bits")).join(small, ["lang", "source"])
    maps = maps.select("lang", F.call_function("div", F.col("word"), F.lit(SHARD // 64)).alias("shard"), "source", "word", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "bits")
    shards = kept.groupBy("lang", F.call_function("div", F.shiftright("id", 6), F.lit(SHARD // 64)).alias("shard")).agg(F.count("*").alias("size"))
    none = shards.join(groups, "lang").select("lang", "shard", "source", F.lit(-1).cast("long").alias("word"), share(zero, F.col("total"), F.col("v")).alias("p"), zero.alias("bits"))

    def shard_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return joint_sums(rows).assign(lang=key[0])

    sums = maps.union(none).groupBy("lang", "shard").applyInPandas(shard_sums, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", zero).alias("value"))

    own = used.join(small, ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("all_n"), F.col("lang_n"), F.col("v")).alias("q"))
    words = own.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), surplus(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(words.withColumn("rank", rank).where(F.col("rank") <= top))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of every language against one another, and each one's 200 telling terms."""
    return divergence(read(spark, sf_dir, "documents"))


#: The same rows from SQL.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT o.lang, o.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) o LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.n + l.v) AS p, 1 + (1000000000 * (k.n + 1)) // (l.n + l.v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
WHERE part = 'pair' OR rank <= 200
"""
