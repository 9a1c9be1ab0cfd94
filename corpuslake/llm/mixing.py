"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslake.llm.common import fresh, materialize, read

#: Bits of a rank, and of one pass of the search for a source's last rank.
RANK_BITS, STEP_BITS = 48, 10


def _key(seed: int) -> dict[str, Column]:
    text = F.coalesce("text", F.lit(""))
    return {"k": F.xxhash64(F.lit(seed), "doc_id", text), "j": F.hash(text, "doc_id")}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) with sid (1, 2, ... by code point, null last), weight and target.

    Weights repeat in that order; targets share `share` of all sizes by weight, stop at `most` times the source's size, and
    the excess is shared anew until none is above. Numbering is done inside range partitions, with one offset for each;
    each sharing is one aggregate, whose two sums are all that the driver sees.
    """
    first = F.col("source").isNull()
    ranged = materialize(sizes.repartitionByRange(first, F.col("source")).withColumn("p", F.spark_partition_id()), "mix-ranged")
    # one row for each partition that Spark made, whatever the number of sources
    offset = ranged.groupBy("p").count().withColumn("before", F.sum("count").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1))).select("p", F.coalesce("before", F.lit(0)).alias("before"))
    sid = (F.col("before") + F.row_number().over(W.partitionBy("p").orderBy(first, "source"))).cast("long")
    numbered = materialize(ranged.join(offset, "p").select("source", "source_size", sid.alias("sid")), "mix-numbered")
    numbered = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(most))
    total, weight = numbered.agg(F.sum("source_size"), F.sum("weight")).first()
    level = share * (total or 0) / (weight or 1)
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        capped, free = numbered.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        new = (share * (total or 0) - (capped or 0.0)) / free if free else float("inf")
        if new <= level * (1 + 1e-15) or not free:
            break
        level = new
    return numbered.withColumn("target", F.least(cap, F.col("weight") * F.lit(level if free else 1e300)))


def allocate(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, favour: str | None = None) -> DataFrame:
    """For every document (doc_id, text, source): doc_id, k and j (which identify its doc_id and text), size, source_size, target, copies and taken.

    A document's expected number of copies is its source's target over the source's size, times its favour over the
    source's mean favour (a column of positive numbers; 1 for null or without such a column), `most` at most. The whole
    part is certain. The rest is its inclusion probability p in a Pareto order sample: documents are ranked by
    (u / (1 - u)) / (p / (1 - p)) with u from a keyed hash, and are taken in that order until the source's words
    are there; the last one counts if that brings the sum nearer. So the sample has a fixed size in words, and reruns agree.

    A source may hold a third of all rows: its last rank is found by passes over histograms of the rank's leading bits (sums per
    bucket, pre-aggregated), and only rows that share the last 38-bit prefix are ever put in order. Texts are read once; passes see a
    narrow table. Null texts have size 0, null sources are a source of their own; rows equal in doc_id and text have equal
    ranks, and any of them may be taken first.
    """
    like = F.coalesce(F.col(favour).cast("double"), F.lit(1.0)) if favour else F.lit(1.0)
    narrow = materialize(docs.select("doc_id", "source", *(c.alias(n) for n, c in _key(seed).items()), word_count(F.col("text")).alias("size"), like.alias("favour")), "mix-rows")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("favour")).alias("liked"))
    sizes = materialize(sizes, "mix-sizes")
    sources = source_targets(sizes.select("source", "source_size"), weights, share, most)
    sources = materialize(sources.join(sizes.select(F.col("source").alias("s"), "liked"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "weight"), "mix-sources")

    expected = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("liked") * F.col("favour"))).otherwise(F.lit(0.0))
    whole = F.floor(F.col("expected") + 1e-12)
    p = F.greatest(F.lit(0.0), F.col("expected") - F.col("whole"))
    u = (F.pmod("k", F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    q = u / (1 - u) * ((1 - F.col("p")) / F.col("p"))
    rows = narrow.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("expected", expected).withColumn("whole", whole).withColumn("p", p)
    rank = F.when((F.col("p") > 0) & (F.col("size") > 0), F.least(F.floor(q / (1 + q) * float(1 << RANK_BITS)), F.lit((1 << RANK_BITS) - 1)).cast("long"))
    rows = materialize(rows.select("doc_id", "k", "j", "sid", "size", "source_size", "target", "whole", rank.alias("rank")), "mix-ranked")

    # words that the certain copies leave open
    state = rows.groupBy("sid", "target").agg(F.sum(F.col("whole") * F.col("size")).alias("certain")).select("sid", (F.col("target") - F.col("certain")).alias("open"), F.lit(0).cast("long").alias("prefix"), F.lit(False).alias("all"))
    state = materialize(state, "mix-state")
    left = RANK_BITS
    while left - STEP_BITS >= 10:
        left -= STEP_BITS
        bucket = F.shiftright("rank", left)
        inside = rows.where("rank is not null").join(state.where("not all"), "sid").where(F.shiftright("rank", left + STEP_BITS) == F.col("prefix"))
        sums = inside.groupBy("sid", "open", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        over = W.partitionBy("sid").orderBy("bucket")
        ends = sums.withColumn("upto", F.sum("words").over(over)).where(F.col("upto") > F.col("open"))
        last = ends.groupBy("sid").agg(F.min(F.struct("bucket", (F.col("open") - F.col("upto") + F.col("words")).alias("open"))).alias("b"))
        # no bucket goes beyond what is open: all ranks from here on are taken
        new = state.join(last, "sid", "left").select("sid", F.coalesce("b.open", "open").alias("open"), F.coalesce("b.bucket", F.shiftleft("prefix", STEP_BITS)).alias("prefix"), (F.col("all") | F.col("b").isNull()).alias("all"))
        state = materialize(new, "mix-state")
    held = rows.join(state, "sid")
    prefix = F.shiftright("rank", left)
    before = F.coalesce(F.sum("size").over(W.partitionBy("sid").orderBy("rank", "doc_id", "k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = held.where(~F.col("all") & (prefix == F.col("prefix"))).withColumn("extra", (before + F.col("size") / 2 <= F.col("open")).cast("int"))
    sure = held.where(F.col("rank").isNull() | F.col("all") | (prefix != F.col("prefix"))).withColumn("extra", F.coalesce((F.col("rank").isNotNull() & (F.col("all") & (prefix >= F.col("prefix")) | (prefix < F.col("prefix")))).cast("int"), F.lit(0)))
    keep = ["doc_id", "k", "j", "size", "source_size", "target", (F.col("whole") + F.col("extra")).cast("int").alias("copies")]
    return sure.select(*keep).union(edge.select(*keep)).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def mix(docs: DataFrame, seed: int = 17, **how) -> DataFrame:
    """The mix itself: docs with one row for each copy taken, and size, source_size, target and copies beside (names changed where docs has them)."""
    k, j, names = fresh(docs.columns, "k"), fresh(docs.columns, "j"), {x: fresh(docs.columns, x) for x in ("size", "source_size", "target", "copies")}
    key = _key(seed)
    taken = allocate(docs, seed=seed, **how).where("copies > 0").dropDuplicates(["k", "j"])
    taken = taken.select(F.col("k").alias(k), F.col("j").alias(j), *(F.col(x).alias(n) for x, n in names.items()))
    out = docs.withColumns({k: key["k"], j: key["j"]}).join(taken, [k, j])
    each = fresh(out.columns, "each")
    return out.withColumn(each, F.explode(F.array_repeat(F.lit(1), F.col(names["copies"])))).drop(each, k, j)


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words."""
    return allocate(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
