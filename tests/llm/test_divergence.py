import random
import re
from collections import Counter, defaultdict

import pytest

from corpuslake.llm import divergence as d

SCHEMA = "lang string, value int, source string, text string, rank int"


def brute(rows, least=3, top=200):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    docs, count, out = defaultdict(Counter), defaultdict(Counter), set()
    for lang, _, source, text, _ in rows:
        docs[lang or ""].update(set(terms(text)))
        count[lang or "", source or ""].update(terms(text))
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        groups = {s: c for (la, s), c in count.items() if la == lang}
        p = lambda c, t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept))  # noqa: B023, E731
        f = lambda a, b: (a - b) ** 2 // b
        whole = sum(groups.values(), Counter())
        for s, c in groups.items():
            pairs = sorted(((-sum(f(p(c, t), p(o, t)) for t in kept), x.encode()) for x, o in groups.items() if x != s))
            words = sorted((-f(p(c, t), p(whole, t)), t.encode()) for t in kept if c[t] and p(c, t) > p(whole, t))
            out |= {(lang, s, "pair", x.decode(), -v, i + 1) for i, (v, x) in enumerate(pairs)} | {(lang, s, "term", x.decode(), -v, i + 1) for i, (v, x) in enumerate(words[:top])}
    return out


@pytest.mark.parametrize("top", [200, 3])
def test_against_counting(spark, monkeypatch, top):
    monkeypatch.setattr(d, "HELD", 50)
    monkeypatch.setattr(d, "SHARD", 64)
    monkeypatch.setattr(d, "CELLS", 300)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcXYZéß水", k=rng.randint(1, 4))) for _ in range(150)]
    say = lambda n: rng.choice([" ", "-", "1"]).join(rng.choices(words, weights=[1 / (i + 1) for i in range(150)], k=n))
    rows = [(rng.choice(["en", "en", "de", None, ""]), i, rng.choice(["a", "a", "é", "Z", None]), say(rng.choice([0, 1, 30, 200])), 0) for i in range(120)]
    rows += [("en", 1, "quiet", None, 0), ("en", 1, "quiet", "", 0), ("fr", 1, "x", "only here", 0), ("fr", 1, "y", "12 34", 0), ("en", 2, "long", "wort Wort " * 20000, 0), *rows[:4]]
    got = d.divergence(spark.createDataFrame(rows, SCHEMA).repartition(5), top=top).collect()
    assert {tuple(r) for r in got} == brute(rows, top=top) and len(got) == len({tuple(r) for r in got})
    # a language without kept terms still has its pairs
    assert ("fr", "x", "pair", "y", 0, 1) in {tuple(r) for r in got}


def test_empty(spark):
    assert d.divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_counts_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n = 10**13
    assert spark.range(1).select(d.share(F.lit(n), F.lit(3 * n), F.lit(7)).alias("p")).first().p == 1 + 10**9 * (n + 1) // (3 * n + 7)
