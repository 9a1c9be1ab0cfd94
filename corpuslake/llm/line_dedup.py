"""Lines that many documents share, found by probing sharded minimal perfect hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.common import bounded_broadcast, fresh, materialize, read
from corpuslake.llm.textkit import LOWER, SPACE, Rolling, mix, slices, utf8

#: Keys of one shard of the index (about 250 KB of arrays), and lines that probe one copy of it (about 1 MB).
SHARD_KEYS, PROBES = 10_000, 20_000
_ONE, _TWO = Rolling(71), Rolling(72)
_LINES = pa.schema([("k", pa.int64()), ("j", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("lead", pa.bool_()), ("h1", pa.int64()), ("h2", pa.int64())])


def _lines(least: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, at = utf8(b.column("text"))
            if not len(data):
                continue
            data = LOWER[data]
            cuts = np.flatnonzero(data == 10)
            start = np.unique(np.concatenate([cuts + 1, at[:-1]]))
            start = start[start < len(data)]
            end = np.append(start[1:], len(data))
            doc = np.searchsorted(at, start, "right") - 1
            full = np.flatnonzero(~SPACE[data])
            if not len(full):
                continue
            a, z = np.searchsorted(full, start), np.searchsorted(full, end)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            low, high = full[np.minimum(a, len(full) - 1)], full[np.maximum(z - 1, 0)] + 1
            first = np.searchsorted(start, at[:-1])
            pos = np.arange(len(start)) - first[doc]
            good = np.flatnonzero((z > a) & (points[np.minimum(high, len(data))] - points[low] >= least))
            low, high, doc = low[good], high[good], doc[good]
            cols = [b.column("k").take(pa.array(doc)), b.column("j").take(pa.array(doc)), b.column("doc_id").take(pa.array(doc)), pa.array(pos[good], pa.int32())]
            h1, h2 = (r.ranges(r.prefix(data), low, high) for r in (_ONE, _TWO))
            lead = np.zeros(len(doc), dtype=bool)
            lead[np.unique(mix(h1 + mix(h2 + doc.astype(np.uint64))), return_index=True)[1]] = True
            cols += [pa.array(lead), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, schema=_LINES)

    return task


def salt(level: int) -> np.uint64:
    return np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)


def build_mph(keys: np.ndarray, gamma: float = 2.0) -> tuple[list[int], np.ndarray]:
    """Levels of bitmaps: a key's slot at a level counts if no other key has it; the others go on to the next level.

    Returns the bits of each level and all bitmaps one after another; a key's number is the count of bits before its own."""
    sizes, maps, level = [], [], 0
    while len(keys):
        n = max(64, int(gamma * len(keys)))
        slot = (mix(keys + salt(level)) % np.uint64(n)).astype(np.int64)
        alone = np.bincount(slot, minlength=n) == 1
        sizes.append(n)
        maps.append(alone)
        keys, level = keys[~alone[slot]], level + 1
    return sizes, np.concatenate(maps) if maps else np.zeros(0, bool)


def probe_mph(sizes: list[int], bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Each key's number, or -1 where no level has it; strangers may get any number, so fingerprints must be compared."""
    rank = np.concatenate([[0], np.cumsum(bits)])
    out, left, base = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), 0
    for level, n in enumerate(sizes):
        slot = (mix(keys[left] + salt(level)) % np.uint64(n)).astype(np.int64) + base
        hit = bits[slot]
        out[left[hit]] = rank[slot[hit]]
        left, base = left[~hit], base + n
    return out


_INDEX = "shard long, parts long, sizes array<long>, bits binary, prints binary, last binary, counts binary, more binary"
_NONE = {"k": "int64", "j": "int64", "pos": "int32"}


def _index(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard: bitmaps, then fingerprints, counts and largest documents in the order that the bitmaps give.

    Of keys that share their first hash one is numbered; the others (among billions of lines a few) stand in a short list beside."""
    keys = pdf["h1"].to_numpy().astype(np.int64).view(np.uint64)
    _, lead = np.unique(keys, return_index=True)
    rest = np.setdiff1d(np.arange(len(keys)), lead)
    sizes, bits = build_mph(keys[lead])
    order = lead[np.argsort(probe_mph(sizes, bits, keys[lead]))]
    col = lambda name, at: pdf[name].to_numpy()[at].astype(np.int64)
    more = np.stack([col(x, rest) for x in ("h1", "h2", "last")])
    return pd.DataFrame([{"shard": pdf["shard"].iloc[0], "parts": pdf["parts"].iloc[0], "sizes": sizes, "bits": np.packbits(bits).tobytes(), "prints": col("h2", order).tobytes(), "last": col("last", order).tobytes(), "counts": col("n", order).tobytes(), "more": more.tobytes()}])


def _probe(lines: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    if not len(index) or not len(lines):
        return pd.DataFrame({c: pd.Series(dtype=t) for c, t in _NONE.items()})
    row = index.iloc[0]
    sizes = [int(x) for x in row["sizes"]]
    h1, h2, own = (lines[x].to_numpy().astype(np.int64) for x in ("h1", "h2", "id"))
    number = probe_mph(sizes, np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(sizes)].astype(bool), h1.view(np.uint64))
    prints, last = np.frombuffer(row["prints"], np.int64), np.frombuffer(row["last"], np.int64)
    hit = (number >= 0) & (prints[number] == h2) & (last[number] != own)
    for a, b, c in np.frombuffer(row["more"], np.int64).reshape(3, -1).T:
        hit |= (h1 == a) & (h2 == b) & (own != c)
    return lines.loc[hit, list(_NONE)]


#: Stands below every doc_id for rows without one.
NO_ID = -(1 << 63)


def drop_shared_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> tuple[DataFrame, dict[str, str]]:
    """Documents (doc_id, text and any other columns) with three more columns: n_lines, n_dropped and kept (the text left).

    A line's key is the line stripped of ASCII blanks with A-Z lower-cased. Keys of least_chars code points or more in
    least_docs documents or more lose all their lines but those of the largest doc_id that holds them. Returns the
    frame and the names of the three columns, which are changed where docs has such columns.

    Only counts of keys are shuffled to find the shared ones. They go into shards of 10 000 keys, each a minimal perfect hash
    with arrays of fingerprints, counts and largest documents. Documents' line hashes (never their text) travel to their shard in parts of
    20 000, each beside a copy of the (four times smaller) arrays, so a line that a third of all documents hold is spread over many tasks and
    an index beyond any memory still has one shard a task. Fingerprint and slot come from two 64-bit hashes; lines
    that share the first one are told apart by the second.

    A null or empty text is one empty line. Repeated rows count as documents of their own, but share their doc_id, so
    the largest keeps its lines in each. A null doc_id is smaller than all others.
    """
    k, j, text = fresh(docs.columns, "k"), fresh(docs.columns, "j"), F.coalesce("text", F.lit(""))
    names = {x: fresh(docs.columns, x) for x in ("n_lines", "n_dropped", "kept")}
    keyed = docs.withColumns({k: F.xxhash64("doc_id", text), j: F.xxhash64(text, "doc_id", F.lit(7))})
    narrow = keyed.select(F.col(k).alias("k"), F.col(j).alias("j"), "doc_id", "text")
    lines = materialize(narrow.mapInArrow(_lines(least_chars), "k long, j long, doc_id long, pos int, lead boolean, h1 long, h2 long"), "lines")
    shared = lines.groupBy("h1", "h2").agg(F.count_if("lead").alias("n"), F.max(F.coalesce("doc_id", F.lit(NO_ID))).alias("last")).where(F.col("n") >= least_docs)
    shared = materialize(shared, "lines-shared")
    shards = -(-shared.count() // SHARD_KEYS) or 1
    of_shard = F.pmod(F.col("h1"), F.lit(shards)).alias("shard")
    parts = materialize(lines.groupBy(of_shard).agg(F.ceil(F.count("*") / PROBES).alias("parts")), "lines-parts")
    index = shared.select("*", of_shard).join(parts, "shard").groupBy("shard").applyInPandas(_index, _INDEX)
    index = materialize(index, "lines-index").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    probes = lines.select("k", "j", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "pos", "h1", "h2", of_shard).join(bounded_broadcast(parts), "shard")
    probes = probes.withColumn("part", F.pmod(F.xxhash64("k", "j", "pos"), F.col("parts"))).drop("parts")
    hits = probes.groupBy("shard", "part").cogroup(index.groupBy("shard", "part")).applyInPandas(_probe, "k long, j long, pos int")
    hits = hits.groupBy("k", "j").agg(F.collect_set("pos").alias(drops := fresh(docs.columns, "drops"))).withColumnsRenamed({"k": k, "j": j})

    split = fresh(docs.columns, "lines")
    out = keyed.withColumn(split, F.split(text, "\n")).join(hits, [k, j], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.coalesce(drops, F.array().cast("array<int>")))
    kept = F.when(F.col(drops).isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n"))
    columns = {names["n_lines"]: F.size(split).cast("long"), names["n_dropped"]: F.coalesce(F.size(F.col(drops)), F.lit(0)).cast("long"), names["kept"]: kept}
    return out.withColumns(columns).select(*docs.columns, *names.values()), names


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared lines dropped from every document."""
    found, _ = drop_shared_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows from SQL.
OP7_SQL = r"""
WITH l AS (SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
           FROM (SELECT doc_id, text, unnest(range(1, 1 + len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
k AS (SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(s.key) FILTER (WHERE doc_id <> s.last) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE s.key IS NULL OR doc_id = s.last), '')) AS kept_sha256
FROM k LEFT JOIN s USING (key) GROUP BY doc_id
"""
