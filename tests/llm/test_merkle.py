import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpuslake.llm.merkle import manifest, op12_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int, node string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc, text, lang, source, n = row[:5]
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*map(enc, (doc, source, lang, None if n is None else n + more, text)))


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def climb(tree, i, h):
    proof = []
    for level in tree[:-1]:
        other = level[i ^ 1] if i ^ 1 < len(level) else None
        h = H(h) if other is None else H(other, h) if i % 2 else H(h, other)
        proof += [other] if other else []
        i //= 2
    return h, proof


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {la: levels([leaf(r) for r in sorted(by[la], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for la in langs}
    whole, out = levels([trees[la][-1][0] for la in langs]), []
    for k, la in enumerate(langs):
        for i, r in enumerate(sorted(by[la], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h, proof = climb(trees[la], i, leaf(r, int(hit)))
            h, more = climb(whole, k, h)
            out.append((r[0], leaf(r), trees[la][-1][0], whole[-1][0], H(*proof, *more), h, h == whole[-1][0]))
    return sorted(out, key=str)


def rows(rng, n):
    out = [(i * 3 - 40, rng.choice([None, "", "x", "é水\n"]) or f"t{i}", rng.choice(["en", "en", "en", "de", None, "Z", "é"]), rng.choice(["a", None]), rng.choice([None, i]), "x", 1, "y") for i in range(n)]
    return [*out, (None, None, None, None, None, "x", 1, "y"), (5, "", "", "", 0, "x", 1, "y"), *out[:3], (2, "w " * 100_000, "en", "a", 2**63 - 1, "x", 1, "y")]


@pytest.mark.parametrize("n", [0, 9, 700])
def test_proofs(spark, tmp_path, n):
    made = rows(random.Random(n), n)
    spark.createDataFrame(made, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op12_manifest(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(made)
    assert any(not r[-1] for r in got) == any(r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 for r in made)


def test_spans_agree_and_the_setting_returns(spark):
    made = rows(random.Random(5), 60)
    df, key = spark.createDataFrame(made, SCHEMA), "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    found = [sorted(tuple(r) for r in manifest(df.where("doc_id is not null"), span=s).collect()) for s in (1, 3, 8)]
    assert found[0] == found[1] == found[2] and all(r[-1] for r in found[0]) and spark.conf.get(key) == before
    changed = manifest(df, tampered={"source": F.when(F.col("doc_id") == 5, "b").otherwise(F.col("source"))}, span=2).where("not verified").collect()
    assert {r.doc_id for r in changed} == {5}


def test_empty_and_single(spark):
    assert manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    one = manifest(spark.createDataFrame([(1, "t", "en", "s", 1, "", 1, "")], SCHEMA)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and bytes(one.proof) == b"" and one.verified
