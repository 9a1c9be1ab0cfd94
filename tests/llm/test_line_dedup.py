import random
from collections import defaultdict

import numpy as np
import pandas as pd

from corpuslake.llm import line_dedup
from corpuslake.llm.line_dedup import build_mph, drop_shared_lines, probe_mph

BLANK = " \t\n\x0b\x0c\r"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, chars, docs):
    held = defaultdict(list)
    for i, (_, t) in enumerate(rows):
        for key in {low(x.strip(BLANK)) for x in (t or "").split("\n")}:
            held[key].append(i)
    rank = lambda d: -(10**30) if d is None else d
    out = []
    for d, t in rows:
        lines, kept = (t or "").split("\n"), []
        for x in lines:
            key = low(x.strip(BLANK))
            if len(key) < chars or len(held[key]) < docs or rank(d) == max(rank(rows[i][0]) for i in held[key]):
                kept.append(x)
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    pool = ["Éa bcd éfghijklm nopqrst", "short", "  Padded LINE of some length\t", "padded line of some length", "x" * 19, "y" * 20, "", "   ", "ä" * 20]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own line number {rng.random()}" for _ in range(rng.randint(0, 8)))) for i in range(50)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (5, rows[5][1]), (None, "y" * 20 + "\nq"), (None, "é" * 25), (None, "é" * 25), (None, "é" * 25)]
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, k int, kept string")
    got, names = drop_shared_lines(df)
    assert sorted(((r["doc_id"], r[names["n_lines"]], r[names["n_dropped"]], r[names["kept"]]) for r in got.collect()), key=str) == brute(rows, 20, 3)
    assert got.columns[:4] == ["doc_id", "text", "k", "kept"] and names["kept"] != "kept"


def test_empty(spark):
    assert drop_shared_lines(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0


def test_perfect_hash_numbers_are_dense():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 5000, dtype=np.uint64))
    sizes, bits = build_mph(keys)
    assert sorted(probe_mph(sizes, bits, keys).tolist()) == list(range(len(keys)))


def test_many_shards_and_parts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    monkeypatch.setattr(line_dedup, "PROBES", 5)
    test_matches_brute_force(spark)


def test_lines_that_share_a_hash_are_told_apart():
    shared = pd.DataFrame({"shard": 0, "parts": 1, "h1": [5, 5, 5, 9], "h2": [1, 2, 3, 1], "n": 3, "last": [10, 20, 30, 40]})
    lines = pd.DataFrame({"k": range(7), "j": 0, "pos": 0, "h1": [5, 5, 5, 5, 9, 9, 7], "h2": [1, 2, 3, 4, 1, 1, 1], "id": [1, 20, 1, 1, 1, 40, 1]})
    assert line_dedup._probe(lines, line_dedup._index(shared))["k"].tolist() == [0, 2, 4]
