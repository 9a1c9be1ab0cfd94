import hashlib
import random

from corpuslake.llm.suffix_dedup import repeated_bytes


def covered(rows, length):
    """For each sequence of tokens the positions inside a window of the length that starts elsewhere too."""
    seen = {}
    for i, body in enumerate(rows):
        for s in range(len(body) - length + 1):
            seen.setdefault(tuple(body[s : s + length]), []).append((i, s))
    gone = [set() for _ in rows]
    for at in seen.values():
        if len(at) > 1:
            for i, s in at:
                gone[i].update(range(s, s + length))
    return gone


def brute(rows, length, words):
    bodies = [(text or "").encode() for _, text in rows]
    out = []
    for (doc, _), body, g, w in zip(rows, bodies, covered(bodies, length), covered([b.split() for b in bodies], words), strict=True):
        kept = bytes(x for p, x in enumerate(body) if p not in g)
        out.append((doc, len(body), len(g), sum(1 for p in g if p - 1 not in g), len(w), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, length, gram, words=20, word_gram=4):
    got = repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), length, gram, words, word_gram).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.n_words_repeated, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute(rows, length, words)


def passage(rng, n_words, n_bytes):
    """So many words that fill so many bytes, blanks included."""
    size = [4] * n_words
    while sum(size) + n_words - 1 < n_bytes:
        size[rng.randrange(n_words)] += 1
    return " ".join("".join(rng.choices("abcdefgh", k=x)) for x in size)


def test_passages_just_under_and_over_the_length(spark):
    """The contract's 400 bytes and 50 words: a passage of 60 words and 399 bytes is no repeated string, but is reported."""
    rng = random.Random(5)
    rows, want = [], {}
    for n, (words, size) in enumerate([(60, 398), (60, 401), (49, 399), (49, 450), (50, 300), (70, 399)]):
        shared = passage(rng, words, size)
        for copy in range(3):
            doc = 10 * n + copy
            # other letters around it, so that neither words nor bytes go on
            rows.append((doc, f"{'qrst'[copy]}{passage(rng, 30, 200)}.{'wxyz'[copy]} {shared} {'qrst'[copy]}{passage(rng, 30, 200)}"))
            want[doc] = (size + 2 if size + 2 >= 400 else 0, words if words >= 50 else 0)
    got = {r.doc_id: (r.n_removed, r.n_words_repeated) for r in repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert sorted((d, r, w) for d, _, r, _, w, _ in brute(rows, 400, 50)) == sorted((d, *x) for d, x in want.items())


def test_matches_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(20)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p))
            parts += [p if rng.random() < 0.5 else p[:cut] + rng.choice("xyz") + p[cut + 1 :], word()]
        rows.append((i, " ".join(parts)))
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(7, rows[7][1])] * 2
    rows += [(200, None), (None, ""), (201, ""), (202, "a" * 300), (203, "ab" * 100), (None, "ab" * 90 + "x" * 50)]
    check(spark, rows, 40, 8)


def test_only_empty(spark):
    check(spark, [], 40, 8)
    check(spark, [(1, None), (2, "short")], 40, 8)
