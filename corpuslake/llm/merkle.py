"""A manifest of Merkle trees over a dataset, and each row's proof climbed by a recursive query. DataFrame and SQL functions only."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.common import bounded_broadcast, discard, materialize, read, sha256_hex
from corpuslake.operators.tables import numbered

#: Levels that one stored link climbs, and copies of a link that more than 2**(2 * SPAN) rows may climb.
SPAN, SALTS = 8, 256
#: Fields of a leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: A path is an array of steps: whether the sibling stands left, and its hash (32 bytes; null: none). What a start leads to, and all its siblings in a row.
_FOLD = "unhex(aggregate({path}, {start}, (h, x) -> sha2(concat(if(x.left, coalesce(lower(hex(x.sibling)), ''), ''), h, if(x.left, '', coalesce(lower(hex(x.sibling)), ''))), 256)))"
_PROOF = "aggregate({path}, X'', (found, x) -> concat(found, coalesce(x.sibling, X'')))"


def leaf_hash(fields: list[Column]) -> Column:
    """Each field as its UTF-8 byte count, a colon and the value, `-` for null; one SHA-256 of them all."""
    return sha256_hex(F.concat(*(F.coalesce(F.concat(F.octet_length(s := c.cast("string")).cast("string"), F.lit(":"), s), F.lit("-")) for c in fields)))


def _hex(c: str) -> Column:
    return F.lower(F.hex(c))


def _above(level: Column) -> Column:
    """The hashes of each two neighbours of a level; the last one may be alone."""
    pair = lambda i: sha256_hex(F.concat(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit(""))))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), pair)


def built(nodes: DataFrame, after: Column, name: str, span: int = SPAN) -> tuple[list[DataFrame], DataFrame]:
    """Binary trees over nodes (tree, pos from 0, hash, n: leaves of the tree, load): the links of each stored level, and (tree, top).

    Every span-th level is stored. A link is one of its nodes: tree, level, pos, hash, load (of leaves), path (the steps to the next stored level
    or the top) and parent, the node that the path leads to; a top's parent is `after`. Nodes meet in blocks of 2**span, which an aggregate
    puts together and which climb all their levels at once, so 100 billion leaves take five passes, each over a 2**span-th of the last."""
    nodes = nodes.withColumn("height", F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0))
    highest, level, links, tops = nodes.agg(F.max("height")).first()[0] or 0, 0, [], []
    while True:
        block = nodes.groupBy("tree", F.shiftright("pos", span).alias("block"), "height").agg(F.array_sort(F.collect_list(F.struct("pos", "hash", "load"))).alias("own"))
        block = block.withColumns({"up": F.least(F.lit(span), F.col("height") - level), "l0": F.transform("own", lambda x: x["hash"])})
        for k in range(span):
            block = block.withColumn(f"l{k + 1}", F.when(F.col("up") > k, _above(F.col(f"l{k}"))).otherwise(F.col(f"l{k}")))
        made = materialize(block, f"{name}-blocks")
        end, ended = F.col(f"l{span}")[0], F.col("height") <= level + span
        place = lambda k: F.shiftright("i", k)
        step = lambda k: F.when(F.col("up") > k, F.struct(((place(k) % 2) == 1).alias("left"), F.unhex(F.get(F.col(f"l{k}"), place(k) + 1 - 2 * (place(k) % 2))).alias("sibling")))
        parent = F.when(ended, after).otherwise(F.struct("tree", F.lit(level + span).cast("long").alias("level"), F.col("block").alias("pos")))
        each = made.select("*", F.posexplode("own").alias("i", "node"))
        links.append(each.select("tree", F.lit(level).cast("long").alias("level"), "node.pos", "node.hash", "node.load", F.array_compact(F.array(*map(step, range(span)))).alias("path"), parent.alias("parent")))
        tops.append(made.where(ended).select("tree", end.alias("top")))
        level += span
        if level >= highest:
            return links, reduce(DataFrame.union, tops)
        nodes = made.where(~ended).select("tree", F.col("block").alias("pos"), end.alias("hash"), F.lit(None).cast(nodes.schema["load"].dataType).alias("load"), "height")


def manifest(docs: DataFrame, order: str = "doc_id", by: str = "lang", fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None, span: int = SPAN) -> DataFrame:
    """A Merkle tree for each value of `by` and one over their roots; for every row its leaf, its roots and what its proof says.

    A leaf hashes the fields (leaf_hash). A tree's leaves ascend by `order` (null first, ties by leaf); every two neighbours make the hash of
    their hex texts, a last one alone the hash of its own, until one remains: subroot. Subroots, ordered by `by` (null first), make root
    likewise. tampered: new values of fields; each row's own proof is folded from the leaf that those make (without any, from its own).

    Returns `order`, leaf, subroot, root, proof (the siblings on the way up in bytes, 32 each), folded_root and verified (it equals root).

    Levels are stored as links to a parent (built()), and a recursive query climbs them: each step joins a row's place to the link
    there, appends its siblings and folds the hash, `span` levels at a time, so that a row is shuffled once for every span and
    not for every level. A link that very many rows climb has SALTS copies. Rows with equal fields have equal leaves and
    take neighbouring places; null fields, empty texts and other columns need no care. An empty table gives no rows."""
    old = {c: F.col(c) for c in fields}
    changed = list((old | (tampered or {})).values())
    leaves = materialize(docs.select(F.col(by).alias("by"), F.col(order).alias("id"), F.unhex(leaf_hash([*old.values()])).alias("leaf"), F.unhex(leaf_hash(changed)).alias("start")), "merkle-leaves")
    placed = materialize(numbered(leaves, [F.col("by").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf")], "place"), "merkle-placed")
    discard(leaves)
    trees = numbered(placed.groupBy("by").agg(F.min("place").alias("first"), F.count("*").alias("n")), [F.col("by").asc_nulls_first()], "tree")
    trees = materialize(trees.select(F.col("by").alias("own_by"), "first", "n", (F.col("tree") - 1).alias("tree")), "merkle-trees")
    nodes = placed.join(bounded_broadcast(trees), F.col("by").eqNullSafe(F.col("own_by")))
    nodes = nodes.select("tree", (F.col("place") - F.col("first")).alias("pos"), _hex("leaf").alias("hash"), "n", F.struct("id", F.nullif("start", "leaf").alias("start")).alias("load"))
    whole, zero = F.lit(-1).cast("long"), F.lit(0).cast("long")
    (own, *higher), tops = built(nodes, F.struct(whole.alias("tree"), zero.alias("level"), F.col("tree").alias("pos")), "merkle", span)
    tops = materialize(tops, "merkle-tops")
    roots = tops.select(whole.alias("tree"), F.col("tree").alias("pos"), F.col("top").alias("hash"), F.lit(trees.count()).cast("long").alias("n"), F.lit(None).cast("string").alias("load"))
    last, root = built(roots, F.lit(None).cast("struct<tree:bigint,level:bigint,pos:bigint>"), "merkle-root", span)

    many = (F.col("tree") < 0) | (F.col("level") >= 2 * span)
    salts = F.explode(F.when(many, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    links = materialize(reduce(DataFrame.union, (x.select("tree", "level", "pos", "path", "parent", salts.alias("salt")) for x in (*higher, *last))), "merkle-links")
    start = own.select(F.col("load.id").alias("id"), F.unhex("hash").alias("leaf"), "tree", "parent", F.expr(_FOLD.format(path="path", start="coalesce(lower(hex(load.start)), hash)")).alias("folded"), F.expr(_PROOF.format(path="path")).alias("proof"))
    known = tops.select("tree", F.col("top").alias("subroot"), whole.alias("over")).join(root.select(F.col("tree").alias("over"), F.col("top").alias("root")), "over").drop("over")
    out = climbed(start, links, span).join(bounded_broadcast(materialize(known, "merkle-roots")), "tree")
    return out.select(F.col("id").alias(order), _hex("leaf").alias("leaf"), "subroot", "root", "proof", _hex("folded").alias("folded_root"), (_hex("folded") == F.col("root")).alias("verified"))


def climbed(start: DataFrame, links: DataFrame, span: int) -> DataFrame:
    """start (id, leaf, tree, parent, folded, proof) after the climb of every row from its parent to the top: a recursive query, whose result is written."""
    spark, views = start.sparkSession, [f"merkle_{x}_{uuid.uuid4().hex}" for x in ("start", "links")]
    start.createOrReplaceTempView(views[0])
    links.createOrReplaceTempView(views[1])
    steps = f"""
        WITH RECURSIVE climb AS (
            SELECT id, leaf, tree, parent, folded, proof FROM {views[0]}
            UNION ALL
            SELECT c.id, c.leaf, c.tree, l.parent, {_FOLD.format(path="l.path", start="lower(hex(c.folded))")}, concat(c.proof, {_PROOF.format(path="l.path")})
            FROM climb c JOIN {views[1]} l ON l.tree = c.parent.tree AND l.level = c.parent.level AND l.pos = c.parent.pos
                AND l.salt = CASE WHEN c.parent.tree < 0 OR c.parent.level >= {2 * span} THEN pmod(xxhash64(c.id, c.leaf), {SALTS}) ELSE 0 END)
        SELECT id, leaf, tree, folded, proof FROM climb WHERE parent IS NULL"""
    # a row limit of the recursion would be one on the table
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        return materialize(spark.sql(steps), "merkle-climbed")
    finally:
        spark.conf.set(key, before)
        for view in views:
            spark.catalog.dropTempView(view)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each with its proof; where 7 divides crc32(doc_id), tampering adds 1 to n_chars (a null doc_id has no crc32 and is left)."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.when(hit, (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")).otherwise(F.col("n_chars").cast("string"))
    out = manifest(read(spark, sf_dir, "documents"), tampered={"n_chars": more})
    return out.select("doc_id", "leaf", "subroot", "root", sha256_hex(F.lower(F.hex("proof"))).alias("proof_sha256"), "folded_root", "verified")


#: The same rows from SQL.
OP12_SQL = r"""
WITH RECURSIVE b AS (SELECT doc_id, lang, source, text, n_chars, CASE WHEN xor(list_reduce(list_prepend(4294967295, flatten([[ord(ch), -1, -1, -1, -1, -1, -1, -1, -1] for ch in string_split(doc_id::VARCHAR, '')])),
       lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END), 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS more FROM documents),
f AS (SELECT doc_id, lang, n_chars, more, coalesce(octet_length(encode(doc_id::VARCHAR))::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(octet_length(encode(source))::VARCHAR || ':' || source, '-')
      || coalesce(octet_length(encode(lang))::VARCHAR || ':' || lang, '-') AS head, coalesce(octet_length(encode(text))::VARCHAR || ':' || text, '-') AS tail FROM b),
l AS (SELECT doc_id, lang, sha256(head || coalesce(length(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
      sha256(head || coalesce(length((n_chars + more)::VARCHAR)::VARCHAR || ':' || (n_chars + more)::VARCHAR, '-') || tail) AS start FROM f),
o AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
up AS (SELECT tree, 0 AS level, pos, leaf AS h, n FROM o
       UNION ALL SELECT tree, any_value(level) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY tree, pos // 2),
s AS (SELECT tree, h, tree - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
above AS (SELECT 0 AS level, pos, h, n FROM s
       UNION ALL SELECT any_value(level) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM above WHERE n > 1 GROUP BY pos // 2),
nodes AS (SELECT tree, level, pos, h, n FROM up UNION ALL SELECT 0, level, pos, h, n FROM above),
climb AS (SELECT doc_id, leaf, tree AS own, tree, 0 AS level, pos, n, start AS h, '' AS proof FROM o
       UNION ALL SELECT c.doc_id, c.leaf, c.own, CASE WHEN c.n = 1 THEN 0 ELSE c.tree END, CASE WHEN c.n = 1 THEN 0 ELSE c.level + 1 END, CASE WHEN c.n = 1 THEN c.tree - 1 ELSE c.pos // 2 END,
              CASE WHEN c.n = 1 THEN (SELECT max(n) FROM s) ELSE (c.n + 1) // 2 END,
              CASE WHEN c.n = 1 THEN c.h ELSE sha256(CASE WHEN x.pos < c.pos THEN x.h ELSE '' END || c.h || CASE WHEN x.pos > c.pos THEN x.h ELSE '' END) END, c.proof || coalesce(x.h, '')
       FROM climb c LEFT JOIN nodes x ON x.tree = c.tree AND x.level = c.level AND x.pos = xor(c.pos, 1) AND c.n > 1 WHERE NOT (c.tree = 0 AND c.n = 1))
SELECT c.doc_id, c.leaf, s.h AS subroot, r.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = r.h AS verified
FROM climb c JOIN s ON s.tree = c.own, (SELECT h FROM above WHERE n = 1) r WHERE c.tree = 0 AND c.n = 1
"""
