"""Secrets in texts: fixed patterns, and strings that a primed compressor finds new in a sensitive context."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.common import fresh, read, sha256_hex
from corpuslake.llm.textkit import slices

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A word that makes a context sensitive (words may overlap), and a candidate: a whole run, with `=` as its padding only.
WORD = re.compile(r"(?=(key|token|secret|passw|auth|credential|bearer|private|signature|session|cookie))", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{14,}(?:=+(?![A-Za-z0-9+/_=-]))?")
MIXED = re.compile(r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]")
#: Least length of a candidate with letters and digits and of any other, and most characters between a sensitive word and it.
LEAST, PLAIN, REACH = 16, 24, 80
#: One linear-time pattern that every document with any span matches; the rest is never looked at again.
ANY = rf"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}|(?s:(?i:key|token|secret|passw|auth|credential|bearer|private|signature|session|cookie).{{0,{REACH}}}[A-Za-z0-9+/_=-]{{{LEAST}}})"
#: Characters of code around a candidate that its compressor has seen, and marginal bytes a character from which it is new.
AROUND, NOVELTY = 1024, 0.6
#: Identifiers that code is made of; the compressor knows them before it starts (fixed values).
IDENTIFIERS = (
    "import export default function return const static public private protected class interface struct enum async await yield lambda self this super "
    "config configuration settings environment variable production development staging password username database connection host port url endpoint "
    "access_token refresh_token client_id client_secret authorization bearer signature certificate private_key public_key session_id cookie "
    "request response header content_type application/json charset utf-8 http https localhost example.com github.com "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000000000000000000000000000 xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx changeme placeholder "
    "get_value set_value to_string from_string parse_int is_valid has_permission create_user delete_user update_record find_by_name initialize"
)


class Novelty:
    """Marginal compressed bytes of a string after its surroundings, with the identifiers as dictionary."""

    def __init__(self) -> None:
        import zstandard

        words = zstandard.ZstdCompressionDict(IDENTIFIERS.encode() * 2, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.zip = zstandard.ZstdCompressor(level=19, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)

    def bytes(self, before: str, candidate: str, after: str) -> int:
        around = f"{before}\n{after}\n".encode("utf-8", "surrogatepass")
        return len(self.zip.compress(around + candidate.encode())) - len(self.zip.compress(around))


def spans(text: str, novelty: Novelty, threshold: float = NOVELTY, around: int = AROUND) -> list[dict]:
    out = [("assign", *m.span(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span(), None) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span(), None) for m in HEX.finditer(text)]
    taken: list[list[int]] = []
    for start, end in sorted((s, e) for _, s, e, _ in out):
        if taken and start < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    words = sorted(m.end(1) for m in WORD.finditer(text))
    for m in CANDIDATE.finditer(text) if words else ():
        start, end = m.span()
        last = bisect_right(words, start) - 1
        if last < 0 or start - words[last] > REACH or end - start < (LEAST if MIXED.search(m[0]) else PLAIN):
            continue
        near = bisect_left(taken, end, key=lambda x: x[0]) - 1
        if near < 0 or taken[near][1] <= start:
            new = novelty.bytes(text[max(0, start - around) : start], m[0], text[end : end + around])
            if new >= threshold * (end - start):
                out.append(("novel", start, end, new))
    return [{"kind": k, "start": s, "end": e, "novelty": n} for k, s, e, n in sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))]


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.int32())]))


def _task(batches: Iterator[pa.RecordBatch], threshold: float, around: int, body: str, name: str) -> Iterator[pa.RecordBatch]:
    novelty = Novelty()
    for b in slices(batches, body):
        text = b.column(body)
        worth = pc.match_substring_regex(text, ANY).fill_null(False).to_pylist()
        found = pa.array([spans(text[i].as_py(), novelty, threshold, around) if w else [] for i, w in enumerate(worth)], _SPAN)
        drop = b.schema.get_field_index(body)
        yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != drop), found], names=[*(x for x in b.schema.names if x != body), name])


def find_secrets(docs: DataFrame, threshold: float = NOVELTY, around: int = AROUND) -> tuple[DataFrame, str]:
    """docs (text and others) with one more column (its name is returned): spans, an array of kind, start, end (code points, end
    exclusive) and novelty, by start and then kind.

    assign, access and hex are fixed patterns, leftmost and non-overlapping per kind. novel: every string of 16 characters or
    more with letters and digits, or 24 with either (`=` only as its padding), within 80 characters after a sensitive word, on its line or a later one, that
    touches none of those, and whose marginal compressed size after the `around` characters on either side and a dictionary of
    identifiers is `threshold` bytes a character or more. A string may be as long as it likes; all of it is measured.
    Whole texts are searched, by one scan; nothing is shuffled. A null or empty text has no spans; repeated rows get equal results.
    """
    name, body = fresh(docs.columns, "spans"), fresh([*docs.columns, "spans"], "body")
    kind = "array<struct<kind:string,start:int,end:int,novelty:int>>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` {kind}"])
    return docs.withColumn(body, F.coalesce("text", F.lit(""))).mapInArrow(lambda it: _task(it, threshold, around, body, name), schema), name


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found, name = find_secrets(docs)
    listed = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter(name, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(name, lambda s: s["kind"] != "novel")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), sha256_hex(listed(base)).alias("base_sha256"), listed(F.col(name)).alias("spans"), n("novel"))
