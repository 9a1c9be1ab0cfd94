import random

import pytest
from pyspark.sql import functions as F

from corpuslake.operators import content, quality


def rows(n, seed=1):
    rng = random.Random(seed)
    return [(i % 5, i, rng.choice([None, "", "a", "é", "1:x"]), rng.choice([None, i])) for i in range(n)]


SCHEMA = "g int, k long, a string, b long"


def hashes(df, by):
    return {tuple(r[c] for c in by): (r.n, r.d) for r in content.contents(df, by, ["k", "a", "b"]).withColumn("d", content.digest()).collect()}


def test_set_hashes_add_up_in_any_order(spark):
    made = rows(300)
    df = spark.createDataFrame(made, SCHEMA)
    whole = hashes(df, ["g"])
    random.Random(2).shuffle(made)
    assert hashes(spark.createDataFrame(made, SCHEMA).repartition(7), ["g"]) == whole
    parts = content.contents(df.withColumn("part", content.bucket("k", 9)), ["g", "part"], ["k", "a", "b"])
    assert {(r.g,): (r.n, r.d) for r in content.merged(parts, ["g"]).withColumn("d", content.digest()).collect()} == whole
    # a copy counts, fields do not run into one another, null is not empty
    assert hashes(df.union(df.where("k = 7")), ["g"]) != whole
    pairs = [(("1", "2"), ("12", "")), ((None, "a"), ("", "a")), (("a", None), (None, "a")), (("1:x", "y"), ("1", ":xy"))]
    for a, b in pairs:
        one = lambda p: spark.createDataFrame([p], "a string, b string").select(content.row_hash(["a", "b"])).first()[0]
        assert one(a) != one(b)
    assert content.contents(df.limit(0), [], ["k"]).first().n == 0


def test_one_changed_row_is_found_in_its_bucket(spark):
    before = spark.createDataFrame(rows(400), SCHEMA)
    now = before.withColumn("a", F.when(F.col("k") == 123, "new").otherwise(F.col("a"))).where("k <> 50")
    kept = content.contents(before.withColumn("bucket", content.bucket("k", 32)), ["bucket"], ["a", "b"])
    assert [r.k for r in content.changed_rows(now, before, kept, "k", ["a", "b"], 32).collect()] == [123]
    assert content.changed_rows(before.repartition(3), before, kept, "k", ["a", "b"], 32).isEmpty()
    own = content.contents(now.withColumn("bucket", content.bucket("k", 32)), ["bucket"], ["a", "b"])
    assert content.differing(kept, own, ["bucket"]).count() == 2


def test_changing_one_input_recomputes_one_key(spark):
    inputs, seen = spark.createDataFrame(rows(200), SCHEMA), []

    def compute(some):
        seen.append(sorted(r.g for r in some.select("g").distinct().collect()))
        return some.groupBy("g").agg(F.count("*").alias("n"), F.max("k").alias("top"))

    none = spark.createDataFrame([], "g int, n long, top long, input_sha256 string")
    first = spark.createDataFrame(content.refreshed(inputs, "g", ["k", "a", "b"], none, compute).collect(), none.schema)
    assert seen.pop() == [0, 1, 2, 3, 4] and first.count() == 5
    content.refreshed(inputs.repartition(3), "g", ["k", "a", "b"], first, compute).collect()
    assert seen.pop() == []
    changed = inputs.where("g <> 4").withColumn("b", F.when(F.col("k") == 12, -1).otherwise(F.col("b")))
    again = {r.g: (r.n, r.top) for r in content.refreshed(changed, "g", ["k", "a", "b"], first, compute).collect()}
    assert seen.pop() == [2] and again == {g: (40, 195 + g) for g in range(4)}


@pytest.mark.parametrize("kind", ["double", "long", "decimal(20,3)", "int"])
def test_percentiles_of_any_range(spark, monkeypatch, kind):
    monkeypatch.setattr(quality, "STEPS", 4)
    monkeypatch.setattr(quality, "FEW", 3)
    rng = random.Random(3)
    draw = {"double": lambda: rng.choice([0.0, 1e-9, -1e9, rng.gauss(0, 1), rng.gauss(0, 1e6)]), "long": lambda: rng.choice([0, rng.randint(-2**62, 2**62), 2**60 + rng.randint(0, 3)]), "decimal(20,3)": lambda: rng.randint(-10**6, 10**6) / 8, "int": lambda: rng.randint(0, 50)}[kind]
    made = [(rng.choice(["a", "a", "a", "b", None]), draw()) for _ in range(400)] + [("only", 5 if kind in ("long", "int") else 5.0), ("b", None), ("none", None)]
    df = spark.createDataFrame(made, f"g string, v {kind if '(' not in kind else 'double'}").withColumn("v", F.col("v").cast(kind))
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r for r in quality.refined_percentiles(df, ["g"], "v", shares).where("g is not null").collect()}
    for g in ("a", "b", "only"):
        values = sorted(v for x, v in made if x == g and v is not None)
        want = [values[round((len(values) - 1) * s)] for s in shares]
        assert [float(got[g][f"p{round(s * 100)}"]) for s in shares] == [float(x) for x in want] and got[g].n == len(values)
        assert (float(got[g].least), float(got[g].largest)) == (float(values[0]), float(values[-1]))
    assert "none" not in got
    everything = quality.refined_percentiles(df.where("g = 'a'"), [], "v", [0.5]).collect()
    assert len(everything) == 1 and everything[0].p50 == got["a"].p50
