import numpy as np
import pytest

from corpuslake.llm.graph_search import nearest, op10_graph_search


def brute(rows, queries, k):
    good = {i: np.array(v, dtype=float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i in queries:
        if i in good:
            d = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(good[i], v, strict=True)))), j) for j, v in good.items() if j != i and len(v) == len(good[i]))
            out[i] = d[:k]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 24))
    rows = [(i, (centres[i % 20] + 0.4 * rng.normal(size=24)).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[3][1]) for i in range(40)] + [(3000, None), (3001, [0.0] * 24), (3002, [float("nan")] * 24), (3003, [None] * 24), (3004, []), (3005, [1.0, 2.0]), (3006, [1.5, 2.0]), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ask = [*range(0, 1500, 50), 3, 2000, 3000, 3001, 3005]
    q = df.where(df.vec_id.isin(ask)).withColumnRenamed("vec_id", "query_id")
    got = nearest(df, q, 10, shard=400).collect()
    want = brute(rows, ask, 10)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert by.keys() == want.keys()
    assert [r.rank for r in got if r.query_id == 50] and all(v == sorted(v) for v in by.values())
    hits = sum(len({j for _, j in by[i]} & {j for _, j in want[i]}) for i in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert by[3] == want[3] and by[2000] == want[2000] and by[3005] == want[3005]


@pytest.mark.parametrize(("mean", "spread"), [(1000.0, 0.1), (1000.0, 1.0), (0.0, 1e20), (0.0, 1e-150), (0.0, 1e150)])
def test_recall_wherever_the_vectors_lie(spark, mean, spread):
    rng = np.random.default_rng(6)
    rows = [(i, (mean + spread * rng.normal(size=32)).tolist()) for i in range(900)] + [(1000 + i, (mean + spread * rng.normal(size=7)).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = [*range(0, 900, 30), *range(1000, 1500, 25)]
    want, got = brute(rows, ask, 10), {}
    for r in nearest(df, df.where(df.vec_id.isin(ask)).withColumnRenamed("vec_id", "query_id"), 10, shard=300).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = sum(len(got[i].keys() & {j for _, j in want[i]}) for i in ask)
    assert hits >= 0.95 * 10 * len(ask) and all(len(got[i]) == 10 for i in ask)
    assert all(np.isclose(got[i][j], d, rtol=1e-12) for i in ask for d, j in want[i] if j in got[i])


def test_one_huge_vector_among_small_ones(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(400)] + [(900, [1e20] * 16), (901, [-1e20, *[1.0] * 15])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = [*range(0, 400, 20), 900, 901]
    want, got = brute(rows, ask, 10), {}
    for r in nearest(df, df.where(df.vec_id.isin(ask)).withColumnRenamed("vec_id", "query_id"), 10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[i] & {j for _, j in want[i]}) for i in ask if i < 400) >= 0.95 * 200 and len(got[900]) == len(got[901]) == 10


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 100 == 0], 10)
    got = {}
    for r in op10_graph_search(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[i] & {j for _, j in want[i]}) for i in want) >= 0.9 * sum(map(len, want.values()))


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(none, none.withColumnRenamed("vec_id", "query_id")).count() == 0
