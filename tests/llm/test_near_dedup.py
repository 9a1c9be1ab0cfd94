import random
import re

import numpy as np

from corpuslake.llm.near_dedup import BANDS, ROWS, most_bits, near_duplicates, odd_sketches, sketch_links


def brute(rows, width):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None), doc == min(ids, default=None)))
    return sorted(out, key=str)


def make(rng):
    rows, n = [], 0
    for _ in range(12):
        words = [f"w{rng.randint(0, 500)}" for _ in range(rng.choice([3, 20, 60, 200]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
            rows.append((n, " ".join(w).capitalize()))
            n += 7
            if rng.random() < 0.1:
                words = w
    return rows + [(n + 1, None), (n + 2, ""), (n + 3, " \t"), (n + 4, "one"), (n + 5, "ONE "), (n + 6, "a b c"), (n + 7, "a b c d"), (3, rows[0][1]), (None, "zz yy xx ww vv"), (None, "q r s t u v")]


def test_matches_brute_force(spark):
    rows = make(random.Random(5))
    for block, shingles in ((64, 4_000_000), (5, 4_000_000), (64, 300)):
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, block=block, shingles=shingles).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == brute(rows, 4)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0


def test_buckets_in_parts_lose_no_link(spark):
    """Parts of four rows; a family of near copies is far larger."""
    rng = random.Random(8)
    rows = make(rng)
    words, n = [f"w{rng.randint(0, 500)}" for _ in range(120)], 10**6
    for i in range(60):
        w = list(words)
        for _ in range(3):
            w[rng.randrange(len(w))] = f"y{rng.randint(0, 10**6)}"
        rows.append((n + i, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, block=5, bucket=4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == brute(rows, 4)


def test_sketch_links_join_what_all_pairs_would(spark):
    rng = np.random.default_rng(3)
    for _ in range(20):
        mins = np.repeat(rng.integers(0, 2**63, (6, BANDS * ROWS), dtype=np.uint64), 12, axis=0)
        for row in mins:
            spots = rng.random(len(row)) < rng.choice([0.02, 0.1, 0.3, 0.5])
            row[spots] = rng.integers(0, 2**63, spots.sum(), dtype=np.uint64)
        bits = odd_sketches(mins).view(np.uint64)
        near = np.bitwise_count(bits[:, None] ^ bits[None]).sum(axis=2) <= most_bits(0.55)

        def labels(pairs):
            root = list(range(len(bits)))
            for a, b in pairs:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
            return root

        src, dst, heads = sketch_links(bits, 0.55)
        assert all(near[a, b] or any(near[b]) for a, b in zip(src, dst, strict=True))
        assert labels(zip(src, dst, strict=True)) == labels(np.argwhere(near).tolist()) and len(heads) <= len(bits) and len(src) < len(bits)
