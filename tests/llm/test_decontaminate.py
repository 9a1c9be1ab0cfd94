import random
import re

from corpuslake.llm import decontaminate
from corpuslake.llm.decontaminate import contamination


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, size=13):
    wins = []
    for i, t in items:
        w = words(t)
        if i is not None:
            wins += [(str(i), w[a : a + size]) for a in range(max(1, len(w) - size + 1)) if w]
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, x in wins:
            for a in range(len(w) - len(x) + 1):
                if w[a : a + len(x)] == x:
                    hit.update(range(a, a + len(x)))
                    ids.add(i)
        out.append((d, len(w), len(hit), ",".join(sorted(ids)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: rng.choice(["The", "of", "a1", "É", "ab", "été", "x"] + [f"r{rng.randint(0, 40)}"])
    items = [(i, rng.choice([" ", ", ", "-"]).join(word() for _ in range(rng.choice([1, 5, 13, 14, 30])))) for i in range(25)] + [(100, None), (101, ""), (102, "!!"), (None, "r1 r2"), (3, "of of of")]
    docs = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rng.choice([0, 5, 60])))]
        if rng.random() < 0.6:
            w = words(rng.choice(items)[1])
            a = rng.randint(0, 3)
            parts += [" ".join(w[a:]).upper() if rng.random() < 0.3 else " ".join(w), " ".join(word() for _ in range(20))]
        docs.append((i, "\n".join(parts)))
    docs += [(200, None), (201, ""), (202, "..."), (5, docs[5][1]), (None, items[4][1])]
    for shuffled in (False, True):
        with monkeypatch.context() as m:
            if shuffled:
                m.setattr(decontaminate, "fits", lambda df, **_: False)
                m.setattr(decontaminate, "bounded_broadcast", lambda df, **_: df)
            got = contamination(spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, k int, words int"), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in got), key=str) == brute(docs, items)


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs, items).count() == 0
    assert contamination(spark.createDataFrame([(1, "a b")], docs.schema), items).collect()[0].n_hit == 0
