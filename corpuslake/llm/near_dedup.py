"""Near-duplicate documents: MinHash bands, odd sketches for candidate verification, exact confirmation on full sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.common import components, materialize, read
from corpuslake.llm.textkit import mix, shingle_sets, slices

#: At a similarity of 0.8 a pair shares no band with a probability of (1 - 0.8**4)**28 < 4e-7.
BANDS, ROWS = 28, 4
#: Bits of an odd sketch, the estimate below which a bucket's pair is no candidate (over 5 standard errors under 0.8), and the
#: one from which a row follows a leader and needs no comparisons of its own but with what the leader's ring holds.
BITS, LOW, CORE = 512, 0.55, 0.9
#: Rows of a bucket that one task compares; larger buckets are dealt into parts, whose leaders are all candidates of the bucket's first row.
BUCKET = 2000
#: Shingles of the sets that a block of the comparison holds, about: 32 MB before they are numbered.
SHINGLES = 4_000_000
#: Stands above every doc_id for rows without one.
NO_ID = 1 << 62
_ODD = np.random.default_rng(61).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FEATURES = pa.schema([("id", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary())])


def odd_sketches(mins: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Rows of min-hashes folded into parity bitmaps: each (position, value) toggles one bit."""
    out = np.zeros((len(mins), bits), dtype=np.uint8)
    rows = np.arange(len(mins))
    for i in range(mins.shape[1]):
        out[rows, (mix(mins[:, i] + np.uint64(i + 1)) % np.uint64(bits)).astype(np.int64)] ^= 1
    return np.packbits(out, axis=1)


def most_bits(similarity: float, samples: int = BANDS * ROWS, bits: int = BITS) -> int:
    """The XOR population count at which the estimate 1 + n/4k * ln(1 - 2c/n) falls to the similarity."""
    return math.floor(bits / 2 * (1 - math.exp(4 * samples / bits * (similarity - 1))))


def _features(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        sets = shingle_sets(b.column("text"), width)
        n = np.array([len(s) for s in sets], dtype=np.int64)
        full = np.flatnonzero(n)
        s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
        keys, sketches = np.zeros((len(n), BANDS), np.uint64), [None] * len(n)
        if len(full):
            every = np.concatenate([sets[i] for i in full])
            start = np.cumsum(n[full]) - n[full]
            s1[full], s2[full] = np.add.reduceat(mix(every + np.uint64(3)), start), np.add.reduceat(mix(mix(every) ^ np.uint64(5)), start)
            mins = np.stack([np.minimum.reduceat(every * odd, start) for odd in _ODD], axis=1)
            for j, x in zip(full.tolist(), odd_sketches(mins), strict=True):
                sketches[j] = x.tobytes()
            for i in range(BANDS):
                key = np.full(len(full), i + 1, dtype=np.uint64)
                for m in mins[:, i * ROWS : (i + 1) * ROWS].T:
                    key = mix(key + m)
                keys[full, i] = key
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(keys.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("doc_id"), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists, pa.array(sketches, pa.binary())], schema=_FEATURES)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows that are sorted by key, a whole group at a time (small groups of a batch come as slices of it)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        edge = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        if held and held[-1].column(key)[0].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            held.append(b.slice(x, y - x))
            if y < len(k):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


_EDGES = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def _edges(src: list, dst: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], schema=_EDGES)


def sketch_links(bits: np.ndarray, low: float, core: float = CORE, rows: int = 256) -> tuple[list[int], list[int], list[int]]:
    """Links whose components are those of all pairs with an estimate of low or more, fewer than there are rows, and the leaders.

    A row leads, and rows of estimate `core` or more follow it and leave. XOR counts obey the triangle inequality, so what is near a
    follower is further from its leader by the follower's own count at most: only rows of that ring are compared with the followers
    as well, and they stay in the pool whatever comes out."""
    most, inner = most_bits(low), most_bits(core)
    edge = most + inner
    left, label, src, dst, heads = np.arange(len(bits)), np.arange(len(bits)), [], [], []
    while len(left):
        lead, left = left[0], left[1:]
        heads.append(int(lead))
        away = np.bitwise_count(bits[left] ^ bits[lead]).sum(axis=1)
        near, follows = away <= most, away <= inner
        ring, crowd = np.flatnonzero((away > most) & (away <= edge)), left[follows]
        for i in range(0, len(ring) if len(crowd) else 0, rows):
            part = ring[i : i + rows]
            met = np.zeros(len(part), dtype=bool)
            for j in range(0, len(crowd), rows):
                met |= (np.bitwise_count(bits[left[part], None] ^ bits[None, crowd[j : j + rows]]).sum(axis=2) <= most).any(axis=1)
            near[part[met]] = True
        # one link to each group that is not joined yet
        groups, first = np.unique(label[left[near]], return_index=True)
        new = groups != label[lead]
        dst += left[near][first[new]].tolist()
        src += [int(lead)] * int(new.sum())
        if new.any():
            label[np.isin(label, groups)] = label[lead]
        left = left[~follows]
    return src, dst, heads


def _leaders(batches: Iterator[pa.RecordBatch], low: float) -> Iterator[pa.RecordBatch]:
    """Candidate links of each part; where a bucket has several parts, all their leaders are linked to the bucket's first row."""
    src, dst, n = [], [], 0
    for g in _groups(batches, "part"):
        ids, first = g.column("id").to_numpy(), g.column("first")[0].as_py()
        bits = np.frombuffer(b"".join(g.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(ids), -1)
        a, b, heads = sketch_links(bits, low) if len(ids) > 1 else ([], [], [0])
        src.append(ids[np.array(a, dtype=np.int64)])
        dst.append(ids[np.array(b, dtype=np.int64)])
        if first is not None:
            src.append(np.full(len(heads), first))
            dst.append(ids[np.array(heads)])
        n += len(src[-1]) + len(a)
        if n > 50_000:
            yield _edges(src, dst)
            src, dst, n = [], [], 0
    if src:
        yield _edges(src, dst)


_SETS = pa.schema([("id", pa.int64()), ("set", pa.binary())])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([s.tobytes() for s in shingle_sets(b.column("text"), width)], pa.binary())], schema=_SETS)


def confirmed(ids: np.ndarray, label: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Links that join all sets of the group which similarity chains connect; pairs known to be joined (same label) are skipped."""
    if (label == label[0]).all():
        return [], []
    size = np.array([len(s) for s in sets], dtype=np.int64)
    start = np.cumsum(size) - size
    words, dense = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(words), dtype=bool)
    label, src, dst = label.copy(), [], []
    for v in range(len(ids) - 1):
        other = np.flatnonzero((label[v + 1 :] != label[v]) & (100 * np.minimum(size[v + 1 :], size[v]) >= percent * np.maximum(size[v + 1 :], size[v]))) + v + 1
        if not len(other):
            continue
        own = dense[start[v] : start[v] + size[v]]
        mark[own] = True
        if len(other) * 2 < len(ids) - v:
            shared = np.add.reduceat(mark[np.concatenate([dense[start[u] : start[u] + size[u]] for u in other])].astype(np.int32), np.cumsum(size[other]) - size[other])
        else:
            shared = np.add.reduceat(mark[dense[start[v + 1] :]].astype(np.int32), start[v + 1 :] - start[v + 1])[other - v - 1]
        mark[own] = False
        for u in other[100 * shared >= percent * (size[other] + size[v] - shared)]:
            if label[u] != label[v]:
                src.append(int(ids[v]))
                dst.append(int(ids[u]))
                label[label == label[u]] = label[v]
    return src, dst


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    src, dst = [], []
    for g in _groups(batches, "part"):
        if g.num_rows > 1:
            a, b = confirmed(g.column("id").to_numpy(), g.column("label").to_numpy(), [np.frombuffer(x.as_py(), np.uint64) for x in g.column("set")], percent)
            src += a
            dst += b
        if len(src) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], schema=_EDGES)
            src, dst = [], []
    if src:
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], schema=_EDGES)


def _in_order(df: DataFrame, *then: str) -> DataFrame:
    return df.repartition("part").sortWithinPartitions("part", *then)


def row_ids() -> Column:
    """A row's doc_id, or for rows without one a number from its text."""
    return F.coalesce("doc_id", F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(1 << 61)))


def near_duplicates(docs: DataFrame, width: int, percent: int = 80, block: int = 64, bucket: int = BUCKET, shingles: int = SHINGLES) -> DataFrame:
    """For every document (doc_id, text): doc_id, n_shingles, component_id and kept, linked at Jaccard >= percent/100;
    row_id (row_ids() gives the same) and stays, which says the same as kept for rows without doc_id too.

    1. One pass over the texts: set size, a 128-bit signature of the set, band keys and the odd sketch of its min-hashes.
    2. Equal sets are one class from here on, so copies cost one row each whatever their number.
    3. Classes that share a band key meet; the XOR population count of their odd sketches rules out pairs far below the
       threshold. What is left of the links joins the same classes as all pairs above it would, whatever a bucket's size: buckets of
       more than `bucket` classes are dealt into parts, and the leaders of all parts are candidates of the bucket's first class.
    4. Components of the candidate edges are where links can be. Inside them full sets are compared exactly: in blocks,
       of bounded rows and shingles, in blocks dealt anew, and where a component of several blocks is not all joined by then, block by block; pairs that
       links join already are skipped.
    5. Components of the confirmed links, carried back to every document.

    Null or empty texts have no shingles and no links. Rows that share a doc_id count as one document as far as links go.
    A row without doc_id can be linked; its component_id is the smallest doc_id reachable, or null if there is none.
    """
    rows = docs.select("doc_id", "text", row_ids().alias("id"))
    features = materialize(rows.mapInArrow(partial(_features, width=width), "id long, doc_id long, n long, s1 long, s2 long, keys array<long>, sketch binary"), "near-features")
    classes = materialize(features.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("node")), "near-classes")
    firsts = materialize(features.where("n > 0").join(classes.select(F.col("node").alias("id")).distinct(), "id").dropDuplicates(["id"]).select("id", "keys", "sketch", F.col("n").alias("shingles")), "near-firsts")

    bands = firsts.select("id", F.explode("keys").alias("key"))
    many = materialize(bands.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1"), "near-buckets")
    parts = F.ceil(F.col("n") / bucket)
    # first is null where all members of the bucket meet in one part
    met = bands.join(many, "key").select("id", F.xxhash64("key", F.pmod(F.xxhash64("key", "id"), parts)).alias("part"), F.when(parts > 1, F.col("first")).alias("first"))
    met = materialize(met, "near-met")
    ordered = _in_order(met.join(firsts.select("id", "sketch"), "id").withColumn("turn", F.xxhash64("part", "id")), "turn")
    candidates = ordered.mapInArrow(partial(_leaders, low=min(LOW, percent / 100 - 0.25)), "src long, dst long")
    member = components(candidates, "near-candidates")

    own = firsts.select(F.col("id").alias("node"), "shingles")
    count = materialize(member.join(own, "node").groupBy("component").agg(F.count("*").alias("n"), F.sum("shingles").alias("shingles")), "near-sizes")
    size = F.least(F.greatest(F.lit(block), F.ceil(F.col("n") / 40)), F.lit(4096))
    placed = member.join(count, "component").select(F.col("node").alias("id"), "component", F.greatest(F.ceil(F.col("n") / size), F.ceil(F.col("shingles") / shingles)).alias("blocks")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    sets = materialize(rows.select("id", "text").join(placed.select("id"), "id").mapInArrow(partial(_sets, width=width), "id long, set binary").dropDuplicates(["id"]).join(placed, "id"), "near-sets")
    inside = _in_order(sets.select("id", F.col("id").alias("label"), "set", F.xxhash64("component", "block").alias("part"))).mapInArrow(partial(_confirm, percent=percent), "src long, dst long")
    inside = materialize(inside, "near-links")
    large = sets.where("blocks > 1")
    links = inside
    if large.limit(1).count():
        labelled = lambda links, name: large.join(components(links, name).select(F.col("node").alias("id"), F.col("component").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
        # dealt anew, so that a family of close copies is one label before any block meets all others
        mixed = labelled(inside, "near-inside").select("id", "label", "set", F.xxhash64("component", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks"))).alias("part"))
        links = materialize(inside.union(_in_order(mixed).mapInArrow(partial(_confirm, percent=percent), "src long, dst long")), "near-links")
        parted = materialize(labelled(links, "near-mixed").select("id", "label", "component", "block", "blocks"), "near-parted")
        apart = parted.groupBy("component").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("component")
        across = parted.join(apart, "component").withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("with <> block")
        across = across.select("id", "label", F.xxhash64("component", F.least("block", "with"), F.greatest("block", "with")).alias("part")).join(large.select("id", "set"), "id")
        links = materialize(links.union(_in_order(across).mapInArrow(partial(_confirm, percent=percent), "src long, dst long")), "near-links")
    joined = components(links, "near-joined")
    found = materialize(classes.join(joined, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component")), "near-found")
    out = features.select("doc_id", "id", "n", F.when(F.col("n") > 0, F.col("s1")).alias("s1"), "s2").join(found, ["s1", "s2"], "left")
    component = F.coalesce("component", "id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(component < NO_ID, component).alias("component_id"), F.col("doc_id").eqNullSafe(F.when(component < NO_ID, component)).alias("kept"), F.col("id").alias("row_id"), (F.col("id") == component).alias("stays"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents on 4-word shingles."""
    return near_duplicates(read(spark, sf_dir, "documents"), 4).drop("row_id", "stays")


#: The same rows from SQL.
OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 3], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id
"""
