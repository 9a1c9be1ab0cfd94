"""Exact search for repeated token sequences: depth-limited digit passes over sampled suffixes. Tokens are bytes or words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.common import discard, materialize, read
from corpuslake.llm.textkit import Rolling, mix, slices, utf8, word_codes

#: Bytes of a repeated string and of the leading digit; the same in words for passages.
LENGTH, GRAM = 400, 64
PASSAGE, WORD_GRAM = 50, 8
_ONE, _TWO = Rolling(81), Rolling(82)
#: Bits of a position beside its hash in one number: texts of up to 4 GB have the same anchors as short ones.
_BITS = np.uint64(32)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of width values, by block prefixes and suffixes."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchored(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of window starts that share an anchor: (first start, last start, anchor), with prefix sums for hashing.

    The anchor of a window is the leftmost of its grams with the least hash, so it depends on the window alone.
    """
    prefix = _ONE.prefix(data)
    n = len(data)
    if n < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, prefix
    pos = np.arange(n - gram + 1, dtype=np.int64)
    grams = _ONE.ranges(prefix, pos, pos + gram)
    packed = (grams >> _BITS << _BITS) | pos.astype(np.uint64)
    least = sliding_min(packed, length - gram + 1)
    fits = np.zeros(n + 1, dtype=np.int32)
    lo, hi = at[:-1], at[1:] - length + 1
    some = hi > lo
    np.add.at(fits, lo[some], 1)
    np.add.at(fits, hi[some], -1)
    starts = np.flatnonzero(np.cumsum(fits)[: len(least)] > 0)
    anchor = (least[starts] & np.uint64((1 << int(_BITS)) - 1)).astype(np.int64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1 if len(starts) else first
    return starts[first], starts[last], anchor[first], prefix


#: Offsets to one block of the third pass.
BLOCK = 16


def _batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(cols[f.name]).view(np.int64) if isinstance(cols[f.name], np.ndarray) and cols[f.name].dtype == np.uint64 else cols[f.name], f.type) for f in schema], schema=schema)


_RUNS = pa.schema([("k", pa.int64()), ("j", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("a", pa.int32()), ("gram", pa.int64()), ("whole", pa.int64())])


Split = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def single_bytes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, at


def _runs(split: Split, length: int, gram: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, at = split(*utf8(b.column("text")))
            lo, hi, a, one = anchored(data, at, length, gram)
            if not len(lo):
                continue
            doc = np.searchsorted(at, lo, "right") - 1
            two, base = _TWO.prefix(data), at[doc]
            yield _batch(_RUNS, k=b.column("k").to_numpy()[doc], j=b.column("j").to_numpy()[doc], lo=lo - base, hi=hi - base, a=a - base, gram=_ONE.ranges(one, a, a + gram), whole=_TWO.ranges(two, lo, hi + length))

    return task


def _resolve(rows: DataFrame, lead: str, whole: list[str], name: str) -> DataFrame:
    """One digit pass: rows whose leading digit occurs once are dropped; the rest get full (its whole string occurs again) and
    pool (its windows must be told apart by a later pass; of equal strings one document's rows stand for all). rows are deleted."""
    again = materialize(rows.groupBy(lead).count().where("count > 1").select(lead), f"{name}-again")
    kept = materialize(rows.join(again, lead), f"{name}-kept")
    discard(rows, again)
    kinds = materialize(kept.groupBy(*whole).agg(F.count("*").alias("n"), F.min("k").alias("first")), f"{name}-kinds")
    # written, so that Spark can split a digit with very many strings where it meets them
    mixed = materialize(kinds.groupBy(lead).agg(F.count("*").alias("kinds")).where("kinds > 1"), f"{name}-mixed")
    known = materialize(kinds.join(mixed, lead, "left").select(*kinds.columns, F.col("kinds").isNotNull().alias("mixed")), f"{name}-known")
    discard(kinds, mixed)
    hit = materialize(
        kept.join(known, whole).select(*kept.columns, (F.col("n") > 1).alias("full"), (F.col("mixed") & ((F.col("n") == 1) | (F.col("k") == F.col("first")))).alias("pool")).where("full or pool"), f"{name}-hit"
    )
    discard(kept, known)
    return hit


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    zip_ = zstandard.ZstdCompressor(level=3)
    for b in slices(batches, "text"):
        data, at = utf8(b.column("text"))
        packed = pa.array([zip_.compress(data[x:y].tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k"), b.column("j"), packed], names=["doc_id", "k", "j", "z"])


def _bodies(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Each row's key, bytes and list of integer structs as a matrix."""
    import zstandard

    unzip = zstandard.ZstdDecompressor()
    at, parts = b.column("spans").offsets.to_numpy(), b.column("spans").values
    parts = [parts.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(parts.type.num_fields)]
    for i, (k, j, z) in enumerate(zip(b.column("k").to_pylist(), b.column("j").to_pylist(), b.column("z"), strict=True)):
        yield k, j, np.frombuffer(unzip.decompress(z.as_py()), np.uint8), np.stack([p[at[i] : at[i + 1]] for p in parts])


def _few(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


_BLOCKS = pa.schema([("k", pa.int64()), ("j", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("gram", pa.int64()), ("core", pa.int64()), ("whole", pa.int64())])


def _blocks(split: Split, length: int):
    """Runs cut at fixed offsets from their anchor: core is what all windows of a block share, whole all that they cover."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            out = []
            for k, j, body, (lo, hi, a, gram) in _bodies(b):
                data, _ = split(body, np.array([0, len(body)]))
                low, high = (a - hi) // BLOCK, (a - lo) // BLOCK
                n = high - low + 1
                run = np.repeat(np.arange(len(lo)), n)
                block = low[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
                first, last = a[run] - block * BLOCK - BLOCK + 1, a[run] - block * BLOCK
                s1, s2 = np.maximum(first, lo[run]), np.minimum(last, hi[run])
                two = _TWO.prefix(data)
                # a window of the block contains all bytes from its last start to the end of its first window
                core = _TWO.ranges(two, np.maximum(last, 0), np.minimum(first + length, len(data))) if len(run) else np.zeros(0, np.uint64)
                g = gram[run].astype(np.uint64) + block.astype(np.uint64)
                out.append((np.full(len(run), k), np.full(len(run), j, np.int32), s1, s2, gram[run], mix(core ^ mix(g)), mix(_TWO.ranges(two, s1, s2 + length) + mix((a[run] - s1).astype(np.uint64)))))
            if out:
                yield _batch(_BLOCKS, **{f.name: np.concatenate(x) for f, x in zip(_BLOCKS, zip(*out, strict=True), strict=True)})

    return task


_WINDOWS = pa.schema([("k", pa.int64()), ("j", pa.int32()), ("lo", pa.int32()), ("gram", pa.int64()), ("whole", pa.int64())])


def _windows(split: Split, length: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            out = []
            for k, j, body, (lo, hi, gram) in _bodies(b):
                data, _ = split(body, np.array([0, len(body)]))
                n = hi - lo + 1
                s = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                out.append((np.full(len(s), k), np.full(len(s), j, np.int32), s, np.repeat(gram, n), _TWO.ranges(_TWO.prefix(data), s, s + length)))
            if out:
                yield _batch(_WINDOWS, **{f.name: np.concatenate(x) for f, x in zip(_WINDOWS, zip(*out, strict=True), strict=True)})

    return task


_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("n_words_repeated", pa.int64()), ("kept", pa.binary())])


def _cut(length: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            out = []
            for doc, (_, _, data, (lo, hi)) in zip(b.column("doc_id").to_pylist(), _bodies(b), strict=True):
                # a pair that starts at -1 is the number of repeated words
                words, lo, hi = hi[lo < 0].sum(), lo[lo >= 0], hi[lo >= 0]
                edge = np.zeros(len(data) + 1, dtype=np.int64)
                np.add.at(edge, lo, 1)
                np.add.at(edge, hi + length, -1)
                gone = np.cumsum(edge)[:-1] > 0
                out.append((doc, len(data), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), int(words), data[~gone].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _CUT, strict=True)], schema=_CUT)

    return task


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary' if f.type == pa.binary() else 'long'}" for f in schema)


def _listed(rows: DataFrame, *cols: str) -> DataFrame:
    return rows.groupBy("k", "j").agg(F.collect_list(F.struct(*cols)).alias("spans"))


def _packed(rows: DataFrame) -> DataFrame:
    return rows.mapInArrow(_pack, "doc_id long, k long, j int, z binary")


def repeated_windows(keyed: DataFrame, split: Split, length: int, gram: int, name: str) -> DataFrame:
    """(k, j, lo, hi): runs of starts, in tokens, of windows of `length` tokens that also start elsewhere in the texts (k, j, text).

    Suffixes are sampled by their own content: of every window the suffix at its least gram (its anchor) is followed, so equal windows
    are always followed from the same place. They are ordered only as deep as a window goes, one digit a pass, and leave as
    soon as they are alone in their group:

    1. the digit is the leading gram of the sampled suffix; windows that share an anchor travel as one run;
    2. the whole run around it: copies of a run are settled here, whatever their number;
    3. runs that only partly agree are cut at fixed offsets into blocks of 16 windows: the tokens that all share, then all;
    4. what is left is told apart window by window.

    Groups with more than one member after the last pass are exactly the repeated windows. No pass moves more than the
    survivors of the one before; a pass's tables are deleted when the next one stands.
    """
    if gram + BLOCK > length:
        raise ValueError("length must be at least gram + 16")
    text = keyed.where(F.octet_length("text") >= length)
    runs = materialize(text.select("k", "j", "text").mapInArrow(_runs(split, length, gram), _ddl(_RUNS)), f"{name}-runs")
    hit = _resolve(runs, "gram", ["gram", "whole"], f"{name}-run")
    work = materialize(_packed(text).drop("doc_id").join(hit.where("pool").select("k", "j").distinct(), ["k", "j"]).dropDuplicates(["k", "j"]), f"{name}-work")
    blocks = materialize(work.join(_listed(hit.where("pool"), "lo", "hi", "a", "gram"), ["k", "j"]).mapInArrow(_blocks(split, length), _ddl(_BLOCKS)), f"{name}-blocks")
    part = _resolve(blocks, "core", ["core", "gram", "whole"], f"{name}-block")
    windows = materialize(work.join(_listed(part.where("pool"), "lo", "hi", "gram"), ["k", "j"]).mapInArrow(_windows(split, length), _ddl(_WINDOWS)), f"{name}-windows")
    again = materialize(windows.groupBy("gram", "whole").agg(F.count("*").alias("n")).where("n > 1"), f"{name}-window-again")
    single = windows.join(again, ["gram", "whole"]).select("k", "j", "lo", F.col("lo").alias("hi"))
    spans = materialize(hit.where("full").select("k", "j", "lo", "hi").union(part.where("full").select("k", "j", "lo", "hi")).union(single), f"{name}-spans")
    discard(hit, work, part, windows, again)
    return spans


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, passage: int | None = PASSAGE, word_gram: int = WORD_GRAM) -> DataFrame:
    """Documents (doc_id, text) without each byte covered by a string of `length` bytes that also starts elsewhere.

    Returns doc_id, n_bytes, n_removed, n_spans, n_words_repeated and kept (the remaining bytes). n_words_repeated counts the words (runs
    of bytes that are no ASCII space) inside a passage of `passage` words that also starts elsewhere: a passage of short words may
    stay under `length` bytes, so nothing of it is removed, but it is reported. passage=None leaves that out (0). Null and
    empty texts have no bytes; repeated rows count as documents of their own.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"k": F.xxhash64("doc_id", "text"), "j": F.hash("text", "doc_id")})
    spans = repeated_windows(keyed, single_bytes, length, gram, "suffix")
    if passage is not None:
        words = _listed(repeated_windows(keyed, word_codes, passage, word_gram, "passage"), "lo", "hi")
        # repeated rows share a key and have the same spans twice; overlaps count once
        new = lambda s, x: F.struct((s["n"] + F.greatest(x["hi"] + passage - F.greatest(x["lo"], s["upto"]), F.lit(0))).alias("n"), F.greatest(s["upto"], x["hi"] + passage).alias("upto"))
        covered = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), new, lambda s: s["n"])
        spans = spans.union(words.select("k", "j", F.lit(-1).alias("lo"), covered.alias("hi")))
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    return _packed(keyed).join(_listed(spans, "lo", "hi"), ["k", "j"], "left").select("doc_id", "k", "j", "z", F.coalesce("spans", none).alias("spans")).mapInArrow(_cut(length), _ddl(_CUT))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 400 bytes removed from every document, and the words in repeated passages of 50 words counted."""
    found = repeated_bytes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_words_repeated")
