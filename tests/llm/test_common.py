import random

from corpuslake.llm import common


def naive(edges):
    root = {}
    for a, b in edges:
        x, y = root.setdefault(a, a), root.setdefault(b, b)
        root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return root


def test_components_equal_a_naive_union(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(45)] + [(200, i) for i in range(201, 240)] + [(5, 5), (300, 301), (301, 300)]
    want = naive([e for e in edges if e[0] != e[1]])
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "src long, dst long"), "t").collect()}
    assert got == want
    assert common.components(spark.createDataFrame([], "src long, dst long"), "t").count() == 0


def test_rounds_grow_with_the_logarithm_of_a_chain(spark, monkeypatch):
    """1000 nodes in ascending order, as versions of a page are."""
    rounds, real = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name: rounds.append(name) or real(df, name))
    chain = spark.range(999).selectExpr("id as src", "id + 1 as dst").union(spark.range(5000, 5999).selectExpr("id as src", "id + 1 as dst"))
    got = common.components(chain, "chain").groupBy("component").count().collect()
    assert sorted((r.component, r["count"]) for r in got) == [(0, 1000), (5000, 1000)]
    assert rounds.count("chain-step") < 12
