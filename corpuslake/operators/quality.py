"""Reasons, labels and percentiles: which rows stay, and what the rest of them look like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslake.operators.tables import discard, settled


def all_reasons(rules: list[tuple[str, Column]]) -> Column:
    """Names of all rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules)))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that holds; null keeps the row."""
    out = F.lit(None).cast("string")
    for name, test in reversed(rules):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def ladder(value: Column, steps: list[tuple[str, int]]) -> list[tuple[str, Column]]:
    """Rules of which at most one holds: the first step that the value does not exceed."""
    out, under = [], None
    for name, most in steps:
        test = value <= most if under is None else (value > under) & (value <= most)
        out.append((name, test))
        under = most
    return out


def label_counts(rows: DataFrame, labels: str, name: str = "label") -> DataFrame:
    return rows.select(F.explode(labels).alias(name)).groupBy(name).count()


def flag_counts(rows: DataFrame, flags: list[str], name: str = "flag") -> DataFrame:
    """True flags of a row, counted for each flag; one pass and one row an executor, zeros kept."""
    one = rows.agg(*(F.count_if(F.col(f)).alias(f) for f in flags))
    return one.select(F.explode(F.array(*(F.struct(F.lit(f).alias(name), F.col(f).alias("count")) for f in flags))).alias("x")).select("x.*")


def nearest_percentiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """Values at index round-half-even((n - 1) * share), with least and largest.

    Exact, over a histogram of distinct values: what is sorted is as long as the range of the value, not as the table. For values of a wide
    range (prices, times) see refined_percentiles()."""
    hist = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy(*by).orderBy(value))
    total = F.sum("n").over(W.partitionBy(*by))
    placed = hist.withColumn("upto", upto).withColumn("total", total)
    picks = [F.min(F.when(F.col("upto") > F.bround((F.col("total") - 1) * F.lit(s), 0), F.col(value))).alias(f"p{round(s * 100)}") for s in shares]
    return placed.groupBy(*by).agg(F.min(value).alias("least"), *picks, F.max(value).alias("largest"), F.first("total").alias("n"))


#: Steps of one histogram, and rows of an interval that are put in order.
STEPS, FEW = 1024, 4096


def refined_percentiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """The same for any numeric value, however many distinct ones there are.

    Each share of each group looks for its rank in an interval: a pass counts the rows of the intervals in STEPS equal parts (partial sums, so
    a hot group sends STEPS rows a task), keeps the part that holds the rank, and narrows the interval to the values met there. All
    shares and groups narrow at once. Rows are only put in order where no more than FEW are left, or where halving ends as
    all that is left is one value; a pass reads the value's column and the keys. Null values do not count."""
    own = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    keys = [*by, "_share"]
    total = own.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("largest"))
    total = settled(total, "percentile-totals")
    rank = F.bround((F.col("n") - 1) * F.col("_share"), 0).cast("long")
    state = total.withColumn("_share", F.explode(F.array(*(F.lit(float(s)) for s in shares))))
    state = settled(state.select(*keys, rank.alias("_rank"), F.col("least").alias("_lo"), F.col("largest").alias("_hi"), F.col("n").alias("_held")), "percentile-state")
    gap = lambda x, y, kind: F.col(x).cast(kind) - F.col(y).cast(kind)
    kind = own.schema["_v"].dataType
    # whole numbers that are one double are told apart by their own difference, which is small
    place = F.coalesce(F.try_divide(gap("_v", "_lo", "double"), gap("_hi", "_lo", "double")), F.try_divide(gap("_v", "_lo", kind), gap("_hi", "_lo", kind)).cast("double"))
    step = F.when(F.col("_lo") == F.col("_hi"), 0).otherwise(F.least(F.lit(STEPS - 1), F.floor(place * STEPS))).cast("int")

    def inside(wanted: DataFrame) -> DataFrame:
        met = own.join(wanted, by) if by else own.join(wanted, F.lit(True))
        return met.where(F.col("_v").between(F.col("_lo"), F.col("_hi")))

    # each pass divides an interval by STEPS, and no value has more than 64 bits to divide
    for _ in range(7):
        wide = (F.col("_held") > FEW) & (F.col("_lo") < F.col("_hi"))
        if state.where(wide).isEmpty():
            break
        parts = inside(state.where(wide)).groupBy(*keys, "_rank", step.alias("_step")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_n").over(W.partitionBy(*keys).orderBy("_step"))
        hit = parts.withColumn("_before", upto - F.col("_n")).where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
        new = hit.select(*keys, (F.col("_rank") - F.col("_before")).alias("_rank"), "_lo", "_hi", F.col("_n").alias("_held"))
        old, state = state, settled(state.where(~wide).unionByName(new), "percentile-state")
        discard(old)
    left = inside(state).groupBy(*keys, "_rank", "_v").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*keys).orderBy("_v"))
    found = left.withColumn("_upto", upto).where(F.col("_upto") > F.col("_rank")).groupBy(*keys).agg(F.min("_v").alias("_v"))
    picks = [F.max(F.when(F.col("_share") == float(s), F.col("_v"))).alias(f"p{round(s * 100)}") for s in shares]
    out = found.groupBy(*by).agg(*picks)
    return (total.join(out, by) if by else total.join(out, F.lit(True))).select(*by, "least", *(f"p{round(s * 100)}" for s in shares), "largest", "n")
