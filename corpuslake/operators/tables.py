"""Helpers of all operators: one written copy of a frame, and components of a graph."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local master may go without, and gets one of its own;
    on a cluster executors would each write to their own disk, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder := tempfile.mkdtemp(prefix="spark-"))
    return folder.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def recursive(spark: SparkSession, sql: str, name: str, **views: DataFrame) -> DataFrame:
    """The rows of a WITH RECURSIVE query over the views named in braces, written and read again. Neither depth nor rows of the recursion are limited."""
    names = {view: f"{view}_{uuid.uuid4().hex}" for view in views}
    limits = {f"spark.sql.cteRecursion{x}Limit": spark.conf.get(f"spark.sql.cteRecursion{x}Limit") for x in ("Row", "Level")}
    for view, df in views.items():
        df.createOrReplaceTempView(names[view])
    try:
        for key in limits:
            spark.conf.set(key, "-1")
        for view, own in names.items():
            sql = sql.replace(f"{{{view}}}", own)
        return settled(spark.sql(sql), name)
    finally:
        for key, before in limits.items():
            spark.conf.set(key, before)
        for view in names.values():
            spark.catalog.dropTempView(view)


#: SQL tests of a VARIANT value.
IS_ARRAY, IS_OBJECT = "try_variant_get({}, '$', 'array<variant>') IS NOT NULL", "try_variant_get({}, '$', 'map<string,variant>') IS NOT NULL"


def discard(*written: DataFrame | None) -> None:
    """Deletes tables of settled() that nothing reads any more; any other frame is left alone."""
    for df in written:
        if df is not None and (path := df.__dict__.get("written_to")) is not None:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with `name`: their place (from 1) in a global order. Range partitions are numbered inside and get one offset each, so no
    task sorts all rows and the driver sees none; rows that are equal in the order may stand either way round."""
    part = "_part"
    ranged = settled(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranged")
    before = ranged.groupBy(part).count().withColumn("_before", F.sum("count").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1))).select(part, F.coalesce("_before", F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy(part).orderBy(*order))
    return ranged.join(before, part).withColumn(name, (F.col("_before") + own).cast("long")).drop(part, "_before")


def min_labels(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of all nodes on the left of a two-sided edge table; the component is the smallest left node.

    Right nodes are hubs: a hub takes the least label of its members and gives it back, then labels jump to their label's
    label, so a hub with a third of all members costs two aggregates and never a pair. Every round is written."""
    edges = settled(edges.select(F.col(left).alias("node"), F.col(right).alias("hub")).distinct(), "edges")
    labels = settled(edges.groupBy("node").agg(F.min("node").alias("label")), "labels")
    while True:
        hubs = edges.join(labels, "node").groupBy("hub").agg(F.min("label").alias("low"))
        near = edges.join(hubs, "hub").groupBy("node").agg(F.min("low").alias("low"))
        mid = settled(labels.join(near, "node").select("node", F.least("label", "low").alias("mid"), "label"), "labels")
        jump = mid.select(F.col("node").alias("mid"), F.col("mid").alias("up"))
        new = settled(mid.join(jump, "mid").select("node", "label", F.least("mid", "up").alias("next")), "labels")
        discard(mid)
        labels = new.select("node", F.col("next").alias("label"))
        if not new.where("label <> next").limit(1).count():
            return labels.select("node", F.col("label").alias("component"))
