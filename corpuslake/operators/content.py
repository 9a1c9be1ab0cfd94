"""Hashes of sets of rows that add up, and recomputation of what changed only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.operators.tables import settled

#: A row's SHA-256 is cut into so many lanes of so many hex digits. Sums of 24-bit lanes stay in 64 bits for 5e11 rows.
LANES, DIGITS = 10, 6


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of a row's fields, each as its UTF-8 byte count, a colon and the value, `-` for null; so no two rows of fields are written alike."""
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s := F.col(c).cast("string")).cast("string"), F.lit(":"), s), F.lit("-")) for c in columns)), 256)


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def contents(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, n, lanes) of each group: the number of its rows and the sums of the lanes of their hashes.

    The order of the rows and how they lie in files and partitions make no difference, copies count, and a group's hash is the sum of its
    parts', so that partial sums are all that is shuffled, and hashes kept of parts (days, buckets, files) make those of a whole by merged()."""
    hashed = rows.select(*by, row_hash(columns).alias("_h"))
    lane = lambda i: F.coalesce(F.sum(F.conv(F.substring("_h", 1 + DIGITS * i, DIGITS), 16, 10).cast("long")), F.lit(0).cast("long"))
    return hashed.groupBy(*by).agg(F.count("*").alias("n"), F.array(*map(lane, range(LANES))).alias("lanes"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """The contents of larger groups from those of their parts."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("lanes", F.lit(i))) for i in range(LANES))).alias("lanes"))


def digest(n: str = "n", lanes: str = "lanes") -> Column:
    """One hex string for a group's contents."""
    return F.sha2(F.concat_ws(",", F.col(n).cast("string"), F.transform(lanes, lambda x: x.cast("string"))), 256)


def differing(stated: DataFrame, actual: DataFrame, by: list[str]) -> DataFrame:
    """Groups whose contents differ, or that one side lacks."""
    a, b = (df.select(*by, digest().alias(name)) for df, name in ((stated, "_a"), (actual, "_b")))
    return a.join(b, by, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*by)


def changed_rows(rows: DataFrame, before: DataFrame, kept: DataFrame, key: str, columns: list[str], buckets: int) -> DataFrame:
    """Keys of the rows that are new or changed since `kept` (contents by bucket) was written of `before`. Only the rows of buckets whose contents
    differ are compared one by one."""
    own = rows.withColumn("bucket", bucket(key, buckets))
    hit = differing(kept, contents(own, ["bucket"], columns), ["bucket"])
    left = own.join(hit, "bucket", "left_semi").select(key, row_hash(columns).alias("_h"))
    right = before.withColumn("bucket", bucket(key, buckets)).join(hit, "bucket", "left_semi").select(key, row_hash(columns).alias("_h"))
    return left.join(right, [key, "_h"], "left_anti").select(key).distinct()


def stale(inputs: DataFrame, key: str, columns: list[str], outputs: DataFrame, made_of: str = "input_sha256") -> DataFrame:
    """(key, made_of) of the keys whose output is missing or was made of other inputs. A key's inputs may be any number of rows, in any order."""
    now = contents(inputs, [key], columns).select(key, digest().alias(made_of))
    return now.join(outputs.select(key, made_of), [key, made_of], "left_anti")


def refreshed(inputs: DataFrame, key: str, columns: list[str], outputs: DataFrame, compute: Callable[[DataFrame], DataFrame], made_of: str = "input_sha256") -> DataFrame:
    """The outputs of all keys, where compute() (inputs of some keys -> a row for each key, with the columns of outputs but made_of) sees the
    stale keys only. Outputs whose key has no input any more go; each row says what it was made of."""
    fresh = settled(stale(inputs, key, columns, outputs, made_of), "stale")
    made = compute(inputs.join(fresh.select(key), key, "left_semi")).join(fresh, key)
    valid = outputs.join(fresh.select(key), key, "left_anti").join(inputs.select(key).distinct(), key, "left_semi")
    return valid.unionByName(made.select(*outputs.columns))
