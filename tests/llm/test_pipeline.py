import random

import corpus_pipeline as p


def sentence(rng, n):
    return " ".join("".join(rng.choices("aeionrst", k=rng.randint(2, 7))) for _ in range(n))


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    item, shared = sentence(rng, 16), sentence(rng, 8)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, sentence(rng, 60), "en", f"s{i % 3}", 0, i) for i in range(40)]
    rows = [(a, t, la, s, len(t), k) for a, t, la, s, _, k in rows]
    first = rows[0][1].split()
    rows += [
        (100, "12 34 !!", "en", "s0", 8, 1), (101, None, "en", "s1", None, 1), (102, "щщщ ффф жжж " * 30, None, "s0", 360, 1),
        (103, " ".join(first[:-1]), "en", "s0", 5, 1), (104, rows[1][1], "en", "s2", 5, 1), (105, f"{sentence(rng, 30)} {item.upper()}", "en", None, 5, 1),
        *((110 + i, f"{sentence(rng, 40)}\n{shared}", "en", "s1", 400, 1) for i in range(4)), (None, sentence(rng, 50), None, "s2", 1, 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k int")
    seen = []
    for name, stage in p.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id: r for r in docs.collect()})
        if name != "mixture":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "k"]
    ids = [set(s) for s in seen]
    every = {r[0] for r in rows}
    assert ids[0] == every - {100, 101, 102}
    assert ids[1] == ids[0] and [shared in seen[1][110 + i].text for i in range(4)] == [False, False, False, True] and seen[1][110].n_chars == len(seen[1][110].text)
    assert ids[2] == ids[1] - {103, 104}
    assert ids[3] == ids[2] - {105}
    assert ids[4] <= ids[3] and len(ids[4]) > 20
    assert docs.columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "k"]


def test_run_and_empty(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
    assert p.run(spark, "/root/testdata/sf0.001").count() > 50
