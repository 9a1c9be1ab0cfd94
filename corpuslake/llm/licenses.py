"""Licence notices in texts: MinHash bands over windows retrieve templates, exact containment verifies them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.common import fresh, read
from corpuslake.llm.license_texts import TEMPLATES
from corpuslake.llm.suffix_dedup import sliding_min
from corpuslake.llm.textkit import LOWER, Rolling, mix, slices, tokens, utf8

#: Words of a shingle, share of a template's shingles that a match holds, bands (one min-hash each).
SHINGLE, CONTAINED, BANDS = 2, 0.8, 16
#: Lengths of the windows (in shingles) that retrieve templates: each by the longest that is no longer than itself; bands that must agree.
WINDOWS, AGREE = (1, 2, 4, 8, 16, 32), 3
#: What stands between words: all but letters, digits and bytes of other characters.
GAP = np.ones(256, dtype=bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_WORDS = Rolling(21)
_ODD = np.random.default_rng(22).integers(1, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingled(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all pairs of neighbouring words, the words' starts and ends, and each document's first word."""
    low = LOWER[data]
    starts, ends, first = tokens(low, at, GAP)
    word = _WORDS.ranges(_WORDS.prefix(low), starts, ends)
    pair = mix(word[:-1] * _ODD[0] + mix(word[1:])) if len(word) > 1 else np.zeros(0, np.uint64)
    return pair, starts, ends, first


class Templates:
    """For each window length and band: the sorted min-hashes of all windows of the templates of that length, with template and offset."""

    def __init__(self, templates: tuple[tuple[str, str], ...]) -> None:
        self.names, self.want, self.length = [], [], []
        windows: dict[int, list[tuple[int, np.ndarray]]] = {}
        for name, text in templates:
            body = np.frombuffer(text.encode(), np.uint8)
            own = shingled(body, np.array([0, len(body)]))[0]
            if len(own):
                width = max(w for w in WINDOWS if w <= len(own))
                windows.setdefault(width, []).append((len(self.names), own))
                self.names.append(name)
                self.want.append(np.unique(own))
                self.length.append(len(own))
        #: For each width: template and offset of each window, and for each band which low bits occur, the sorted min-hashes and their windows.
        self.bands: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]] = {}
        for width, own in windows.items():
            n = [len(x) - width + 1 for _, x in own]
            bands = []
            for odd in _ODD:
                mins = np.concatenate([sliding_min(x * odd, width) for _, x in own])
                order = np.argsort(mins, kind="stable")
                seen = np.zeros(1 << 16, dtype=bool)
                seen[mins & np.uint64(0xFFFF)] = True
                bands.append((seen, mins[order], order))
            self.bands[width] = np.repeat([i for i, _ in own], n), np.concatenate([np.arange(x) for x in n]), bands


@lru_cache(maxsize=4)
def prepared(templates: tuple[tuple[str, str], ...]) -> Templates:
    return Templates(templates)


def candidates(pair: np.ndarray, known: Templates) -> dict[int, np.ndarray]:
    """template -> where its copies would start, by every window of the text that agrees with one of the template's in AGREE bands or more."""
    out: dict[int, np.ndarray] = {}
    for width, (number, offset, bands) in known.bands.items():
        if len(pair) < width:
            continue
        met = []
        for odd, (seen, mins, window) in zip(_ODD, bands, strict=True):
            least = sliding_min(pair * odd, width)
            at = np.flatnonzero(seen[least & np.uint64(0xFFFF)])
            first, last = np.searchsorted(mins, least[at]), np.searchsorted(mins, least[at], "right")
            n = last - first
            spot = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            met.append(np.repeat(at, n) * len(number) + window[spot])
        both, count = np.unique(np.concatenate(met), return_counts=True)
        both = both[count >= AGREE]
        start, t = both // len(number) - offset[both % len(number)], number[both % len(number)]
        for x in np.unique(t).tolist():
            out[x] = np.unique(start[t == x])
    return out


def matches(pair: np.ndarray, first: np.ndarray, templates: tuple[tuple[str, str], ...], share: float, block: int = 1 << 20) -> list[tuple[int, str, int, int, float]]:
    """(document, name, first word, end word, containment) of verified windows, overlapping ones of a name joined.

    Windows of text and templates overlap at every word, so a copy's windows meet their own ones whatever stands around it; fewer than
    3 of 16 bands agree with a probability of 2e-4 at a similarity of 0.6, and 1e-5 at 0.67, the least of a single window that a match may have. A template may lie a fifth of its length beside
    a candidate's start (where words were added or left out), so all windows of its size from there to there are verified."""
    known, out = prepared(templates), {}
    for t, starts in candidates(pair, known).items():
        length, want, name = known.length[t], known.want[t], known.names[t]
        reach = length // 5 + 1
        every = np.unique((starts[:, None] + np.arange(-reach, reach + 1)).ravel())
        every = every[(every >= 0) & (every + length <= len(pair))]
        doc = np.searchsorted(first, every, "right") - 1
        inside = every + length < first[doc + 1]
        every, doc = every[inside], doc[inside]
        for i in range(0, len(every), max(1, block // length)):
            at = every[i : i + max(1, block // length)]
            window = np.sort(pair[at[:, None] + np.arange(length)], axis=1)
            new = np.ones(window.shape, dtype=bool)
            new[:, 1:] = window[:, 1:] != window[:, :-1]
            place = np.minimum(np.searchsorted(want, window), len(want) - 1)
            held = ((want[place] == window) & new).sum(axis=1) / len(want)
            for j in np.flatnonzero(held >= share).tolist():
                out.setdefault((int(doc[i + j]), name), []).append((int(at[j]), int(at[j]) + length + 1, float(held[j])))
    joined = []
    for (d, name), found in out.items():
        found.sort()
        run = list(found[0])
        for a, e, c in found[1:]:
            if a < run[1]:
                run[1], run[2] = max(run[1], e), max(run[2], c)
            else:
                joined.append((d, name, *run))
                run = [a, e, c]
        joined.append((d, name, *run))
    return sorted(joined, key=lambda x: (x[0], x[2], x[1]))


_FOUND = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))


def _task(batches: Iterator[pa.RecordBatch], templates: tuple[tuple[str, str], ...], share: float, body: str, name: str) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, body):
        data, at = utf8(b.column(body))
        pair, starts, ends, first = shingled(data, at)
        rows: list[list[dict]] = [[] for _ in range(b.num_rows)]
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        for d, x, a, e, c in matches(pair, first, templates, share):
            rows[d].append({"license": x, "start": int(points[starts[a]] - points[at[d]]), "end": int(points[ends[e - 1]] - points[at[d]]), "containment": c})
        drop = b.schema.get_field_index(body)
        yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != drop), pa.array(rows, _FOUND)], names=[*(x for x in b.schema.names if x != body), name])


def find_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, share: float = CONTAINED) -> tuple[DataFrame, str]:
    """docs (text and others) with one more column (its name is returned): licenses, an array of license, start, end (code points)
    and containment, by start.

    Words are compared without case and punctuation. Overlapping windows of 1 to 32 word pairs retrieve the templates with which they share
    a band; a match is a window of the template's own size that holds `share` of its distinct word pairs, so whole licences are found
    among other text and with changed words. templates: name -> texts, whole licences or notices of any length. Templates of one
    word are never found. Whole texts are searched in one scan; nothing is shuffled. Null and empty texts have no matches.
    """
    flat = tuple((name, text) for name, texts in (templates or TEMPLATES).items() for text in texts)
    name, body = fresh(docs.columns, "licenses"), fresh([*docs.columns, "licenses"], "body")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` array<struct<license:string,start:int,end:int,containment:double>>"])
    return docs.withColumn(body, F.coalesce("text", F.lit(""))).mapInArrow(lambda it: _task(it, flat, share, body, name), schema), name


def fullest(found: Column) -> Column:
    """Of matches that overlap, those that none surpasses in containment (versions of a licence differ in one word)."""
    return F.filter(found, lambda m: ~F.exists(found, lambda o: (o["start"] < m["end"]) & (m["start"] < o["end"]) & (o["containment"] > m["containment"])))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document, the fullest of those that overlap."""
    found, name = find_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = found.withColumn(name, fullest(F.col(name)))
    listed = F.array_join(F.transform(name, lambda m: F.concat_ws(":", m["license"], m["start"], m["end"])), ",")
    best = F.array_max(F.transform(name, lambda m: m["containment"]))
    return found.select("doc_id", F.size(name).cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform(name, lambda m: m["license"]))), ",").alias("licenses"), listed.alias("spans"), best.alias("containment"))
