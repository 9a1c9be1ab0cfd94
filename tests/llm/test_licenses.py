import random
import re

from corpuslake.llm.licenses import TEMPLATES, find_licenses, fullest


def words(t):
    return [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9\u0080-\U0010ffff]+", t or "")]


def brute(text):
    w, out = words(text), set()
    for name, texts in TEMPLATES.items():
        for t in texts:
            x = [a for a, _, _ in words(t)]
            want = set(zip(x, x[1:]))
            for i in range(len(w) - len(x) + 1):
                own = [a for a, _, _ in w[i : i + len(x)]]
                if len(want & set(zip(own, own[1:]))) >= 0.8 * len(want):
                    out.add(name)
    return out


def test_matches_brute_force(spark):
    rng = random.Random(2)
    every = [t for x in TEMPLATES.values() for t in x]
    rows = []
    for i in range(200):
        t = rng.choice(every).split()
        if rng.random() < 0.5:
            t[rng.randrange(len(t))] = "changed"
        if rng.random() < 0.3:
            t = [x.upper() for x in t]
        fill = lambda: " ".join(rng.choice(["under", "the", "license", "foo", "bär", "version"]) for _ in range(rng.randint(0, 40)))
        rows.append((i, f"{fill()} {rng.choice([' ', '  * ', chr(10)]).join(t)}. {fill()}", 1))
    whole = next(t for t in TEMPLATES["MIT"] if len(t) > 500).split()
    rows.append((299, " ".join([*fill().split(), *whole[:30], "another", *whole[30:70], *whole[72:]]), 1))
    rows += [(300, None, 1), (301, "", 1), (302, "MIT", 1), (303, "é" * 3, 1), (304, "Released under the MIT License", 1)]
    out, name = find_licenses(spark.createDataFrame(rows, "doc_id long, text string, licenses int"))
    got = {r.doc_id: r[name] for r in out.collect()}
    assert name != "licenses" and len(got) == len(rows)
    for i, t, _ in rows:
        assert {m.license for m in got[i]} == brute(t), (i, t)
    assert [(m.license, m.start, m.end, m.containment) for m in got[304]] == [("MIT", 0, 30, 1.0)]


def test_empty(spark):
    assert find_licenses(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0


def test_fullest_of_overlapping(spark):
    out, name = find_licenses(spark.createDataFrame([(1, "This is licensed under the GNU General Public License, version 3. Released under the MIT License")], "doc_id long, text string"))
    assert [m.license for m in out.select(fullest(out[name]).alias("m")).first().m] == ["GPL-3.0", "MIT"]
    assert {m.license for m in out.first()[name]} >= {"GPL-2.0", "GPL-3.0", "MIT"}
