import random

import pytest

from corpuslake.llm.mixing import allocate, mix


def targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, out = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in out]
        if not free:
            return out
        level = (total - sum(out.values())) / sum(w[s] for s in free)
        new = {s: 2.0 * sizes[s] for s in free if 2 * sizes[s] <= level * w[s]}
        if not new:
            return out | {s: level * w[s] for s in free}
        out |= new


def make(rng, n=600):
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 3, 40, 200]))), rng.choice(["b", "b", "b", "a", "é", "z", "Z", None]), 5, "x") for i in range(n)]
    return rows + [(n, None, "a", 1, "x"), (n + 1, " \t", "empty", 1, "x"), (n + 2, "x y\x1cz q", None, 1, "x"), (None, "one two", "a", 1, "x"), (7, rows[7][1], rows[7][2], 5, "x"), (n + 3, "w " * 5000, "b", 1, "x")]


SCHEMA = "doc_id long, text string, source string, size int, copies string"


def test_targets_and_taken(spark):
    rows = make(random.Random(1))
    df = spark.createDataFrame(rows, SCHEMA)
    got = allocate(df).collect()
    again = allocate(df.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.k, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    source = {r[0]: r[2] for r in rows}
    sizes, taken, want = {}, {}, {}
    for r in rows:
        n = len([x for x in __import__("re").split(r"[\x20\x09-\x0D]+", r[1] or "") if x])
        sizes[r[2]] = sizes.get(r[2], 0) + n
    want = targets(sizes)
    for r in got:
        s = source[r.doc_id]
        assert r.taken in (0, r.size, 2 * r.size) and r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= (2500 if s == "b" else 110), (s, taken[s], t)
    whole = mix(df)
    assert whole.columns[:5] == ["doc_id", "text", "source", "size", "copies"] and whole.count() == sum(r.copies for r in got)


def test_sample_equals_plain_pareto_order_sampling(spark):
    """Every source's documents in the order of their ranks, one by one, from the keys that the operator reports."""
    import math

    rows = [r for r in make(random.Random(3)) if r[0] is not None][:590]
    source = {r[0]: r[2] for r in rows}
    got = allocate(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {}
    for r in got:
        by.setdefault(source[r.doc_id], []).append(r)
    for held in by.values():
        size, target = held[0].source_size, held[0].target
        if not size:
            assert all(r.taken == 0 for r in held)
            continue
        expected = min(2.0, target / size)
        whole = math.floor(expected + 1e-12)
        p, open_, want = max(0.0, expected - whole), target - whole * sum(r.size for r in held), {r.k: whole for r in held}

        def rank(r, p=p):
            u = (r.k % 2**52 + 0.5) / 2**52
            q = u / (1 - u) * ((1 - p) / p)
            return min(math.floor(q / (1 + q) * 2**48), 2**48 - 1)

        upto = 0
        for r in sorted((r for r in held if r.size and p > 0), key=lambda r: (rank(r), r.doc_id, r.k)):
            if upto + r.size / 2 > open_:
                break
            want[r.k] += 1
            upto += r.size
        assert {r.k: r.copies for r in held} == want


def test_favour_raises_inclusion(spark):
    rows = [(i, "a b c d", "s" if i % 2 else "t", 3.0 if i % 4 < 2 else 1.0) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, f double")
    got = allocate(df, share=0.5, favour="f").collect()
    liked = sum(r.taken for r in got if r.doc_id % 4 < 2)
    assert liked > 1.8 * sum(r.taken for r in got if r.doc_id % 4 >= 2)
    assert abs(sum(r.taken for r in got) - 8000) <= 8


def test_empty(spark):
    assert allocate(spark.createDataFrame([], SCHEMA)).count() == 0
    assert allocate(spark.createDataFrame([(1, None, None, 1, "x")], SCHEMA)).collect()[0].taken == 0
