import random

import pytest

from corpuslake.llm.language_id import Model, grams, identify, op9_language_id, train


def test_grams_stay_inside_their_text():
    import pyarrow as pa

    code, at = grams(pa.array(["ab", None, "", "a1 B!"]))
    assert at.tolist() == [0, 3, 3, 3]
    assert [hex(int(c)) for c in code[:3]] == ["0x61", "0x610062", "0x6100620000"]
    assert len(code) == 7


def test_probabilities_sum_to_one():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(2)
    own = []
    for letters in ("abcde", "cdefg"):
        code, _ = grams(pa.array([" ".join("".join(rng.choices(letters, k=4)) for _ in range(200))]))
        own.append(np.unique(code, return_counts=True))
    m = Model(["x", "y"], own)
    syms = m.grams[0][0]
    for head in (0x6100620063, 0x630063, 0):
        p = np.exp(m.lookup((np.uint64(head << 16) & np.uint64(2**64 - 1)) | syms))
        assert p.sum(axis=0) == pytest.approx([1, 1], abs=1e-3)


def test_model_equals_kneser_ney_from_its_definition():
    """Counts in dictionaries, one recursion; seen and unseen grams of two languages."""
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    rng, counted = random.Random(7), []
    for letters in ("abcde", "cdefgh"):
        code, _ = grams(pa.array([" ".join("".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(60)) for _ in range(3)]))
        counted.append(code)
    symbols_ = {int(c) & 0xFFFF for code in counted for c in code}

    def probability(levels, order, code):
        if not order:
            return 1 / max(2, len(symbols_))
        level, head = levels[order], code >> 16
        total, kinds = sum(n for g, n in level.items() if g >> 16 == head), sum(1 for g in level if g >> 16 == head)
        low = probability(levels, order - 1, code & ((1 << 16 * (order - 1)) - 1))
        return low if not total else max(level.get(code, 0) - 0.75, 0) / total + 0.75 * kinds / total * low

    model = Model(["x", "y"], [np.unique(c, return_counts=True) for c in counted])
    asked = [int(c) for code in counted for c in rng.sample(code.tolist(), 40)] + [sum(rng.choice(list(symbols_)) << 16 * i for i in range(4)) for _ in range(40)]
    got = np.exp(model.lookup(np.array(asked, dtype=np.uint64)).astype(float))
    for i, code in enumerate(counted):
        levels = {4: Counter(int(c) for c in code)}
        for order in (3, 2, 1):
            levels[order] = Counter(g & ((1 << 16 * order) - 1) for g in levels[order + 1])
        assert got[:, i] == pytest.approx([probability(levels, 4, c) for c in asked], rel=1e-4)


def test_edge_cases(spark):
    words = {"x": "abcd", "y": "wxyz"}
    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choices(words[la], k=5)) for _ in range(40)), la, 1) for i, la in enumerate(["x", "y"] * 20)]
    extra = [(100, None, None, 1), (101, "", "x", 1), (102, "123 !?", None, 1), (103, "щщщ ффф жжж ццц " * 20, None, 1), (104, "abcd " * 50_000, None, 1), (None, "wxyz wzyx", None, 1)]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, lang_pred int")
    got, names = identify(df, train(df))
    by = {r["doc_id"]: r for r in got.collect()}
    pred = names["lang_pred"]
    assert pred != "lang_pred" and all(by[i][pred] == la for i, _, la, _ in rows) and not any(by[i][names["rejected"]] for i in range(40))
    assert [by[i][pred] for i in (100, 101, 102, 104, None)] == ["und", "und", "und", "x", "y"]
    assert by[103][names["rejected"]] and by[100][names["rejected"]] and 0.9 < by[104]["score"] <= 1
    none = spark.createDataFrame([], df.schema)
    assert train(none) is None and identify(none, None)[0].count() == 0
    assert {r[pred] for r in identify(df, None)[0].collect()} == {"und"}


def test_held_out_accuracy(spark):
    got = op9_language_id(spark, "/root/testdata/sf0.001").alias("g").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id")
    r = got.where("held_out").selectExpr("count(*) n", "avg(cast(lang_pred = lang as int)) acc").first()
    assert r.n > 20 and r.acc >= 0.95


def test_every_gram_is_kept_whatever_the_size_of_a_shard(spark):
    """Symbols of all the 16 bits; the same results from one shard as from many, and those of the model in memory over all grams."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    letters = {"x": "abcdefg", "y": "efghijk", "z": "가나다힣漢字"}
    rows = [(i, " ".join("".join(rng.choices(letters[la], k=4)) for _ in range(60)), la) for i, la in enumerate(["x", "y", "z"] * 8)]
    rows += [(100, "abce efgh unseen qq 漢a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    many = train(df, "lang", 50)
    out = [sorted(map(tuple, identify(df, m)[0].select("doc_id", "lang_pred", "entropy", "rejected").collect())) for m in (many, train(df))]
    assert out[0] == out[1]
    assert max(map(len, many.files.values())) > 10
    own = [np.unique(grams(pa.array([t for _, t, la in rows if la == x]))[0], return_counts=True) for x in "xyz"]
    full = Model(["x", "y", "z"], own)
    codes, _ = grams(pa.array([t for _, t, _ in rows]))
    assert many.lookup(codes) == pytest.approx(full.lookup(codes), abs=1e-4)
    assert many.floor == full.floor and many.mean == pytest.approx(full.mean, abs=1e-6) and many.sd == pytest.approx(full.sd, abs=1e-6)
