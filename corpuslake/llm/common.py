"""Shared helpers of the training-data operators: reading tables, cutting lineage, bounded broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.operators.tables import discard, settled, shared_folder

__all__ = ["ascii_lower", "bounded_broadcast", "components", "discard", "fits", "fresh", "materialize", "read", "sha256_hex", "shared_folder", "small_batches"]

#: Nothing above these figures is ever broadcast by a hint of ours.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of fewer rows than Spark's default, as ours hold whole texts: a batch of 10 000 doubles its buffers beyond 100 MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage is cut and survives lost executors. discard() deletes it."""
    small_batches(df.sparkSession)
    return settled(df, name)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, row_bytes: int | None = None) -> bool:
    """Whether a count proves df small enough to be broadcast. df must be cheap to count (a materialized table). row_bytes bounds a
    row where columns are wide; it is measured by the caller."""
    limit = min(rows, BROADCAST_BYTES // row_bytes) if row_bytes else rows
    return df.limit(limit + 1).count() <= limit


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, row_bytes: int | None = None) -> DataFrame:
    """A broadcast hint where df fits; otherwise df as it is, and Spark shuffles."""
    return F.broadcast(df) if fits(df, rows, row_bytes) else df


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(taken: Iterable[str], name: str) -> str:
    """A column name that clashes with none of those taken (case-insensitively)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def components(edges: DataFrame, name: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Connected components of an undirected edge table: (node, component), component = smallest node.

    Contraction: every round each node takes the best node of its neighbourhood (itself included), then that one's own choice, and edges
    are contracted to the choices. Even rounds prefer many neighbours (a hub takes its whole star at once), ties and odd rounds
    draw fresh priorities. Priorities don't follow the ids, so a chain in id order shrinks like any other graph: at least half of
    the nodes that still have edges are gone after an odd round, in expectation, and rounds grow with the logarithm of their
    number. Nodes with no edge are not in the result. Tables of a round are written to the shared folder and deleted when
    nothing reads them any more; nothing is gathered on the driver but whether edges are left.
    """
    ordered = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialize(ordered(edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))), f"{name}-pairs")
    choices: list[DataFrame] = []
    while not pairs.isEmpty():
        both = pairs.union(pairs.select("b", "a"))
        draw = lambda c: F.xxhash64(F.lit(len(choices)), c)  # noqa: B023, E731
        if len(choices) % 2 == 0:
            degree = both.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"))
            near = both.join(degree, F.col("b") == F.col("id")).groupBy("a").agg(F.max(F.struct("n", draw("b").alias("p"), F.col("b").alias("id"))).alias("near"), F.count("*").alias("n"))
            best = F.greatest("near", F.struct("n", draw("a").alias("p"), F.col("a").alias("id")))
        else:
            near = both.groupBy("a").agg(F.max(F.struct(draw("b").alias("p"), F.col("b").alias("id"))).alias("near"))
            best = F.greatest("near", F.struct(draw("a").alias("p"), F.col("a").alias("id")))
        step = materialize(near.select(F.col("a").alias("node"), best["id"].alias("label")), f"{name}-step")
        chosen = materialize(step.join(step.select(F.col("node").alias("label"), F.col("label").alias("choice")), "label").select("node", "choice"), f"{name}-chosen")
        discard(step)
        side = lambda c: chosen.select(F.col("node").alias(c), F.col("choice").alias(f"{c}2"))  # noqa: B023, E731
        left = pairs.join(side("a"), "a").join(side("b"), "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        old, pairs = pairs, materialize(ordered(left), f"{name}-pairs")
        discard(old)
        choices.append(chosen)
    if not choices:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = choices[0].select("node", F.col("choice").alias("component"))
    for later in choices[1:]:
        labels = labels.join(later.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("choice", "component").alias("component"))
    labels = materialize(labels, f"{name}-labels")
    smallest = labels.groupBy("component").agg(F.min("node").alias("smallest"))
    out = materialize(labels.join(smallest, "component").select("node", F.col("smallest").alias("component")), f"{name}-components")
    discard(pairs, labels, *choices)
    return out


Query = Callable[[SparkSession, str], DataFrame]
