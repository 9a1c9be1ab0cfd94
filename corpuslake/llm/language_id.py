"""Language identification by interpolated Kneser-Ney character models held in sorted arrays, in shards of the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.common import fresh, materialize, read
from corpuslake.llm.textkit import slices

ORDER = 4
DISCOUNT = 0.75
#: Entries of a shard (about; the shards are ranges of grams), and shards that a Python worker keeps.
SHARD_GRAMS, KEPT_SHARDS = 500_000, 16
#: Grams that a training task holds before it passes them on.
HELD = 1 << 19
#: Code points that are classified; all above are no letters.
POINTS = 0x32400
UNKNOWN = "und"


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """Code point -> 16-bit symbol of its lower case; 0 for what is no letter."""
    out = np.zeros(POINTS + 1, dtype=np.uint64)
    for i in range(POINTS):
        c = chr(i)
        if c.isalpha():
            x = ord(low) if len(low := c.lower()) == 1 else i
            out[i] = (x & 0xFFFF) ^ (x >> 16) * 0x9E5 & 0xFFFF or 1
    return out


def grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Packed grams (ORDER symbols of 16 bits, the newest lowest) of all texts, and where each text's begin.

    Runs of other characters count as one blank; a text starts and ends with a blank, and no gram looks beyond its text."""
    texts = [t or "" for t in col.to_pylist()]
    points = np.frombuffer("".join(f"\n{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    length = np.array([len(t) + 2 for t in texts], dtype=np.int64)
    first = np.cumsum(length) - length
    sym = symbols()[np.minimum(points, POINTS)]
    head = np.zeros(len(sym), dtype=bool)
    head[first] = True
    keep = (sym > 0) | head
    keep[1:] |= sym[:-1] > 0
    at = np.concatenate([[0], np.cumsum(keep)])[first]
    sym = sym[keep]
    n = len(sym)
    since = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    code = sym.copy()
    for lag in range(1, ORDER):
        code[lag:] |= np.where(since[lag:] >= lag, sym[:-lag], np.uint64(0)) << np.uint64(16 * lag)
    # a text's first blank is given, not predicted
    real = np.ones(n, dtype=bool)
    real[at] = False
    return code[real], np.concatenate([[0], np.cumsum(real)])[at]


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return code, np.bincount(where, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


_COUNTS = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out() -> pa.RecordBatch:
        rows = [(pa.array([k] * len(c)), pa.array(c.view(np.int64)), pa.array(n)) for k, (c, n) in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*rows, strict=True)], schema=_COUNTS)

    for b in slices(batches, "text", 1 << 18):
        langs = np.array(b.column("lang").to_pylist(), dtype=object)
        for lang in set(langs.tolist()):
            code, _ = grams(b.column("text").filter(pa.array(langs == lang)))
            if len(code):
                new = np.unique(code, return_counts=True)
                held[lang] = _counted([held[lang], new]) if lang in held else new
        if sum(len(c) for c, _ in held.values()) > HELD:
            yield out()
    if held:
        yield out()


class Model:
    """Kneser-Ney models of all languages side by side, in memory: what the shards are tested against.

    For each order: sorted packed grams with a row of log-probabilities (one for each language), and sorted packed
    contexts with a row of log back-off weights. Looking up costs one binary search for known grams, whatever the number
    of languages; an unknown gram adds its context's weight and goes on with the next shorter gram.
    """

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]], discount: float = DISCOUNT) -> None:
        self.langs, self.grams, self.contexts = langs, [], []
        every = [np.unique(np.concatenate([c for c, _ in counts]))]
        levels = [counts]
        for order in range(ORDER - 1, 0, -1):
            mask = np.uint64((1 << (16 * order)) - 1)
            # continuation counts: how many different symbols stand before the gram
            levels.append([np.unique(c & mask, return_counts=True) for c, _ in levels[-1]])
            every.append(np.unique(every[-1] & mask))
        self.floor = np.log(1.0 / max(2, len(every[-1])))
        for order in range(1, ORDER + 1):
            keys, level = every[ORDER - order], levels[ORDER - order]
            heads = keys >> np.uint64(16)
            ctx = np.unique(heads)
            where = np.searchsorted(ctx, heads)
            low = np.exp(self._known(order - 1, keys))
            p, back = np.empty((len(keys), len(langs))), np.zeros((len(ctx), len(langs)))
            self.mean, self.sd = np.zeros(len(langs)), np.zeros(len(langs))
            for i, (code, n) in enumerate(level):
                c = np.zeros(len(keys))
                c[np.searchsorted(keys, code)] = n
                total, kinds = np.bincount(where, c, len(ctx)), np.bincount(where, c > 0, len(ctx))
                weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
                p[:, i] = np.where(total[where] > 0, np.maximum(c - discount, 0) / np.maximum(total[where], 1), 0) + weight[where] * low[:, i]
                back[:, i] = np.log(weight)
                # what each occurrence would cost had it not been counted: the entropy to expect of new texts
                left = -np.log(np.maximum(c - 1 - discount, 0) / np.maximum(total[where] - 1, 1) + weight[where] * low[:, i])
                self.mean[i] = np.average(left, weights=c)
                self.sd[i] = np.sqrt(np.average((left - self.mean[i]) ** 2, weights=c))
            self.grams.append((keys, np.log(p).astype(np.float32)))
            self.contexts.append((ctx, back.astype(np.float32)))

    def _known(self, order: int, codes: np.ndarray) -> np.ndarray:
        """Log-probabilities of grams of an order, from the shorter orders built so far."""
        return self.lookup(codes & np.uint64((1 << (16 * order)) - 1), order) if order else np.full((len(codes), len(self.langs)), self.floor)

    def lookup(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        if not order:
            return np.full((len(codes), len(self.langs)), self.floor, dtype=np.float32)
        keys, logp = self.grams[order - 1]
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        out = logp[at]
        miss = np.flatnonzero(keys[at] != codes)
        if len(miss):
            ctx, back = self.contexts[order - 1]
            heads = codes[miss] >> np.uint64(16)
            c = np.minimum(np.searchsorted(ctx, heads), len(ctx) - 1)
            out[miss] = np.where((ctx[c] == heads)[:, None], back[c], 0) + self.lookup(codes[miss] & np.uint64((1 << (16 * (order - 1))) - 1), order - 1)
        return out


@lru_cache(maxsize=KEPT_SHARDS)
def _shard(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted grams, their languages' numbers and values of a file in the shared folder."""
    import pyarrow.fs
    import pyarrow.parquet as pq

    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    t = pq.read_table(path, columns=["code", "l", "v"], filesystem=fs, partitioning=None)
    return t["code"].to_numpy(), t["l"].to_numpy().astype(np.int16), t["v"].to_numpy()


class Shards:
    """Every language's model over every gram that was counted, as files of the shared folder.

    For each order two tables, one of grams with their log-probability and one of contexts with their log back-off weight,
    a row for each language that has them; each is cut into files by ranges of grams. Only the names and bounds of the files, and
    a few numbers a language, are held here; a worker loads one file after another and looks up a block's distinct grams in it.
    """

    def __init__(self, langs: list[str], floor: float, mean: np.ndarray, sd: np.ndarray, files: dict[tuple[str, int], list[tuple[int, int, str]]]) -> None:
        self.langs, self.floor, self.mean, self.sd, self.files = langs, floor, mean, sd, files
        # where the files do not stay in a worker's memory, larger blocks of text share each reading of them
        whole = sum(map(len, files.values())) <= KEPT_SHARDS
        self.block = max(1 << 12, (1 << (18 if whole else 23)) * 16 // max(16, len(langs)))

    def _values(self, table: tuple[str, int], codes: np.ndarray) -> np.ndarray:
        """A row for each of the sorted codes and a column for each language; NaN where the table has none."""
        out = np.full((len(codes), len(self.langs)), np.nan, dtype=np.float32)
        for low, high, uri in self.files.get(table, []):
            a, b = np.searchsorted(codes, low), np.searchsorted(codes, high, "right")
            if a < b:
                code, lang, v = _shard(uri)
                first = np.searchsorted(code, codes[a:b])
                size = np.searchsorted(code, codes[a:b], "right") - first
                at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                out[np.repeat(np.arange(a, b), size), lang[at]] = v[at]
        return out

    def _known(self, codes: np.ndarray, order: int) -> np.ndarray:
        if not order:
            return np.full((len(codes), len(self.langs)), self.floor, dtype=np.float32)
        out = self._values(("grams", order), codes)
        miss = np.flatnonzero(np.isnan(out).any(axis=1))
        if len(miss):
            heads, head = np.unique((codes[miss].view(np.uint64) >> np.uint64(16)).view(np.int64), return_inverse=True)
            tails, tail = np.unique(codes[miss] & ((1 << (16 * (order - 1))) - 1), return_inverse=True)
            less = np.nan_to_num(self._values(("contexts", order), heads))[head] + self._known(tails, order - 1)[tail]
            out[miss] = np.where(np.isnan(out[miss]), less, out[miss])
        return out

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        distinct, where = np.unique(codes.view(np.int64), return_inverse=True)
        return self._known(distinct, ORDER)[where]


def train(docs: DataFrame, lang: str = "lang", shard_grams: int = SHARD_GRAMS) -> Shards | None:
    """A model from all rows with a text and a language; None if there are none.

    Every text is counted and every counted gram of every order is kept, whatever their number; probabilities and the entropy to
    expect are joined and aggregated on Spark. The driver gets names and bounds of files of about shard_grams entries."""
    spark = docs.sparkSession
    rows = docs.select(F.col(lang).cast("string").alias("lang"), "text").where("lang is not null and text is not null")
    counts = materialize(rows.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "language-grams")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().limit(1001).collect())
    if not langs:
        return None
    if len(langs) > 1000:
        raise ValueError("more than 1000 languages: the models would not be bounded")
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(langs)), "l int, lang string"))
    levels = {ORDER: counts.join(numbers, "lang").select("l", "code", "n")}
    for order in range(ORDER - 1, 0, -1):
        # continuation counts: how many different symbols stand before the gram
        shorter = F.col("code").bitwiseAND(F.lit((1 << (16 * order)) - 1).cast("long"))
        levels[order] = materialize(levels[order + 1].groupBy("l", shorter.alias("code")).agg(F.count("*").alias("n")), "language-level")
    floor = float(np.log(1.0 / max(2, levels[1].select("code").distinct().count())))
    tables: dict[tuple[str, int], DataFrame] = {}
    for order in range(1, ORDER + 1):
        files = max(1, -(-levels[order].count() // shard_grams))
        sharded = lambda df, name: materialize(df.repartitionByRange(files, "code").sortWithinPartitions("code", "l"), f"language-{name}")  # noqa: B023, E731
        level = levels[order].withColumn("head", F.shiftrightunsigned("code", 16))
        weight = F.lit(DISCOUNT) * F.col("kinds") / F.col("total")
        contexts = level.groupBy("l", F.col("head").alias("code")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        tables["contexts", order] = sharded(contexts.withColumn("v", F.log(weight).cast("float")), "contexts")
        joined = level.join(tables["contexts", order].select("l", F.col("code").alias("head"), "total", "kinds"), ["l", "head"])
        if order == 1:
            joined = joined.withColumn("low", F.lit(float(np.exp(floor))))
        else:
            tail = F.col("code").bitwiseAND(F.lit((1 << (16 * (order - 1))) - 1).cast("long"))
            low = tables["grams", order - 1].select("l", F.col("code").alias("tail"), F.exp(F.col("v").cast("double")).alias("low"))
            joined = joined.withColumn("tail", tail).join(low, ["l", "tail"])
        p = (F.col("n") - DISCOUNT) / F.col("total") + weight * F.col("low")
        # what each occurrence would cost had it not been counted: the entropy to expect of new texts
        left = -F.log(F.greatest(F.col("n") - 1 - DISCOUNT, F.lit(0.0)) / F.greatest(F.col("total") - 1, F.lit(1)) + weight * F.col("low"))
        tables["grams", order] = sharded(joined.select("l", "code", F.log(p).cast("float").alias("v"), "n", left.alias("left")), "order")
    mean, sd = np.zeros(len(langs)), np.zeros(len(langs))
    n, x = F.col("n").cast("double"), F.col("left")
    for r in tables["grams", ORDER].groupBy("l").agg(F.sum(n).alias("n"), F.sum(n * x).alias("x"), F.sum(n * x * x).alias("xx")).collect():
        mean[r["l"]] = r["x"] / r["n"]
        sd[r["l"]] = np.sqrt(max(0.0, r["xx"] / r["n"] - mean[r["l"]] ** 2))
    found: dict[tuple[str, int], list[tuple[int, int, str]]] = {}
    for key, df in tables.items():
        bounds = df.select("code", F.input_file_name().alias("uri")).groupBy("uri").agg(F.min("code").alias("low"), F.max("code").alias("high"))
        found[key] = sorted((r["low"], r["high"], r["uri"]) for r in bounds.collect())
    return Shards(langs, floor, mean, sd, found)


_FOUND = "lang_pred string, score double, entropy double, rejected boolean"


def _predict(model, batches: Iterator[pa.RecordBatch], names: list[str], body: str) -> Iterator[pa.RecordBatch]:
    m: Shards | None = model.value if model is not None else None
    for b in slices(batches, body, m.block if m is not None else 1 << 18):
        n = b.num_rows
        pred, score, entropy, rejected = [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.ones(n, dtype=bool)
        code, at = grams(b.column(body))
        size = np.diff(np.append(at, len(code)))
        full = np.flatnonzero(size)
        if m is not None and len(full):
            sums = np.add.reduceat(m.lookup(code).astype(np.float64), at[full], axis=0)
            cross = -sums / size[full][:, None]
            best = cross.argmin(axis=1)
            low = cross[np.arange(len(full)), best]
            # evidence of many symbols is worth that of 100 at most, as neighbouring symbols are no independent draws
            odds = np.exp(-(cross - low[:, None]) * np.minimum(size[full], 100)[:, None])
            score[full], entropy[full] = 1 / odds.sum(axis=1), low
            rejected[full] = low > m.mean[best] + 0.5 * (-m.floor - m.mean[best]) + 4 * m.sd[best] / np.sqrt(size[full])
            for i, x in zip(full.tolist(), best.tolist(), strict=True):
                pred[i] = m.langs[x]
        drop = b.schema.get_field_index(body)
        cols = [c for i, c in enumerate(b.columns) if i != drop] + [pa.array(pred), pa.array(score), pa.array(entropy), pa.array(rejected)]
        yield pa.RecordBatch.from_arrays(cols, names=[*[x for x in b.schema.names if x != body], *names])


def identify(docs: DataFrame, model: Shards | None) -> tuple[DataFrame, dict[str, str]]:
    """docs with four more columns (names as returned): lang_pred, score, entropy and rejected.

    lang_pred is the language whose model gives the least cross-entropy a symbol; `und` for a text that is null or has no
    letter, or if nothing was learned. score (0 to 1) is that language's share under all models, over 100 symbols at most.
    rejected: no letter, or an entropy that lies over half of the way from the language's own mean to a uniform draw
    and four standard errors more, so short texts are given more room.
    """
    names = {x: fresh(docs.columns, x) for x in ("lang_pred", "score", "entropy", "rejected")}
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model) if model is not None else None
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{names[x.split()[0]]}` {x.split()[1]}" for x in _FOUND.split(", "))])
    listed, body = list(names.values()), fresh(docs.columns, "body")
    return docs.withColumn(body, F.col("text")).mapInArrow(lambda it: _predict(held, it, listed, body), schema), names


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    found, _ = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")
