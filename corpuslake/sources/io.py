"""Reading and writing: JSON trees and lines, card folders, wikitext templates, line lists, TSV, manifests, sessions."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_corrupt"


def write_packed(files: DataFrame, name: str, text: str, root: str) -> None:
    """Texts under the relative names they would have as files, many in each part: a small file of its own costs a folder, an open, a rename and
    a place in a listing, whatever it holds. The pack is replaced whole or not at all."""
    replaced(files.sparkSession, root, files.select(F.col(name).alias("source_file"), F.col(text).alias("value")).write.parquet)


def read_packed(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """source_file and value of packed files whose own name is of the glob pattern, by the rules of Spark's pathGlobFilter."""
    named = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    return spark.read.schema("source_file string, value string").parquet(root).where(F.rlike(F.substring_index("source_file", "/", -1), F.lit(rf"(?s)\A(?:{named})\z")))


def json_tree(spark: SparkSession, root: str, pattern: str = "*.json", holds: str | None = None, packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """All JSON files below a folder (source_file relative to it, source_type, json), and those that can't be parsed.

    pattern is a glob on the file name; `holds` drops files without that string before anything is parsed; packed: the folder is one of write_packed()."""
    if packed:
        files = read_packed(spark, root, pattern)
    else:
        found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("wholetext", True).text(root)
        base = re.sub(r"^[a-z0-9]+:/*", "/", root).rstrip("/") + "/"
        path = F.col("_metadata.file_path")
        files = found.select(F.substr(path, F.instr(path, F.lit(base)) + F.lit(len(base))).alias("source_file"), "value")
    rows = files.select("source_file", F.col("value").alias("json"))
    rows = rows.where(F.contains("json", F.lit(holds))) if holds else rows
    rows = rows.withColumn("source_type", F.get(F.split("source_file", "/"), F.lit(0))).withColumn("_ok", F.try_parse_json("json").isNotNull())
    return rows.where("_ok").drop("_ok"), rows.where("not _ok").select("source_file", F.lit("not JSON").alias("error"))


def document_metadata(docs: DataFrame, json: str = "json") -> DataFrame:
    """document_id, title, description and chapter from the quest object, else from the first of talkId, groupId and id."""
    v = F.try_parse_json(F.col(json))
    at = lambda p, kind="string": F.try_variant_get(v, p, kind)
    there = lambda p: F.nullif(F.nullif(at(p), F.lit("")), F.lit("0"))
    return docs.withColumns({
        "document_id": F.coalesce(there("$.quest.id"), there("$.talkId"), there("$.groupId"), there("$.id"), F.lit("")),
        "title": F.coalesce(at("$.quest.title"), F.lit("")), "description": F.coalesce(at("$.quest.description"), F.lit("")), "chapter": F.to_json(F.try_variant_get(v, "$.quest.chapter", "variant")),
    })


def _row(text: Column, schema: T.StructType) -> Column:
    """An object of the schema; BAD beside its fields holds a text that is none."""
    return F.from_json(text, T.StructType([*schema.fields, T.StructField(BAD, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})


def json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines and the lines that aren't rows, with their file; blank lines are skipped. strict raises at the first bad line."""
    reader = spark.read.option("mode", "FAILFAST") if strict else spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
    if strict:
        return reader.schema(schema).json(path), spark.createDataFrame([], f"source_file string, {BAD} string")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_file"), "value").where(F.trim("value") != "")
    parsed = lines.withColumn("_row", _row(F.col("value"), schema))
    return parsed.where(f"_row.{BAD} is null").select("_row.*").drop(BAD), parsed.where(f"_row.{BAD} is not null").select("source_file", F.col("value").alias(BAD))


def replaced(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Runs write() on a folder aside and puts that in the place of `path`, on whatever file system Spark writes to.

    Until everything is written and committed, what was there stays as it was, so a write that fails or is killed leaves the old data; after
    that two renames follow, and if the second fails the first is taken back. Overwriting in place would delete the old data first."""
    name = spark._jvm.org.apache.hadoop.fs.Path
    mark = uuid.uuid4().hex
    own, new, old = name(path), name(f"{path.rstrip('/')}.new-{mark}"), name(f"{path.rstrip('/')}.old-{mark}")
    fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write(new.toString())
    except BaseException:
        fs.delete(new, True)
        raise
    there = fs.exists(own)
    if there and not fs.rename(own, old):
        raise OSError(f"{path} can't be put aside; the new data are in {new.toString()}")
    if not fs.rename(new, own):
        if there:
            fs.rename(old, own)
        raise OSError(f"{new.toString()} can't take the place of {path}")
    if there:
        fs.delete(old, True)


def write_json_lines(rows: DataFrame, path: str, nulls: bool = True) -> None:
    """One object a line in column order; the folder is replaced whole or not at all."""
    replaced(rows.sparkSession, path, lambda to: rows.write.option("ignoreNullFields", not nulls).json(to))


def write_report(values: dict[str, Column], rows: DataFrame, path: str) -> DataFrame:
    """One row of aggregates over a table as one JSON object, which takes the place of the last one when it is complete; returns it."""
    report = rows.agg(*(c.alias(k) for k, c in values.items()))
    replaced(rows.sparkSession, path, lambda to: report.coalesce(1).write.option("ignoreNullFields", False).json(to))
    return report


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    lines = rows.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().sort(column)
    replaced(rows.sparkSession, path, lines.write.text)


def read_lines(spark: SparkSession, path: str, column: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias(column)).where(F.col(column) != "")


def write_tsv(rows: DataFrame, path: str) -> None:
    """Tabs and line ends inside values become blanks."""
    clean = [F.translate(F.col(c).cast("string"), "\t\n\r", "   ").alias(c) for c in rows.columns]
    replaced(rows.sparkSession, path, rows.select(*clean).write.option("sep", "\t").option("header", True).option("quote", "").csv)


def card_folder(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A card a file, with its name without ending as card_file."""
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return spark.read.option("multiLine", True).schema(schema).json(path).select("*", name.alias("card_file"))


def write_cards(cards: DataFrame, key: str, path: str) -> None:
    """A folder for each card, all replaced at once."""
    replaced(cards.sparkSession, path, cards.write.partitionBy(key).json)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))



def templates(pages: DataFrame, text: str, name: str) -> DataFrame:
    """Blocks {{name ...}} of each page with nested blocks inside, in order; the name is a prefix, as in {{name/row|...}}. A block that is
    not closed is an error. One page is one row."""

    @F.udtf(returnType="block string, block_index int")
    class Blocks:
        def eval(self, body: str):
            import re

            opened, first, n = 0, -1, 0
            for m in re.finditer(r"\{\{|\}\}", body or ""):
                if m[0] == "{{":
                    if first < 0 and body.startswith(name, m.end()):
                        first, opened = m.start(), 0
                    opened += 1
                elif first >= 0:
                    opened -= 1
                    if not opened:
                        yield body[first : m.end()], n
                        first, n = -1, n + 1
            if first >= 0:
                raise ValueError(f"template {name} at {first} is not closed")

    return pages.lateralJoin(Blocks(F.col(text).outer()))


def template_parameters(block: Column) -> Column:
    """key -> value of the lines |key=value; a value goes on to the next such line, other lines that begin with a bar included. Of
    repeated keys the last counts; the block's own closing braces belong to no value."""
    body = F.regexp_replace(block, r"\}\}$", "")
    mark = "\x00"
    cut = F.slice(F.split(F.regexp_replace(body, r"(?dm)^\|(?=[^=\n]+=)", mark), mark), 2, 1 << 30)
    keyed = F.transform(cut, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.regexp_replace(p, r"(?s)^[^=]*=\s*|\s+$", "").alias("value")))
    last = F.filter(keyed, lambda x, i: ~F.exists(F.slice(keyed, i + 2, F.size(keyed)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def sessions(spark: SparkSession, path: str, schema: T.StructType, most: int = 20, tie: str = "session_file", packed: bool = False) -> DataFrame:
    """Stored sessions of version 1 with messages, newest first (then the later file name, or another field); unreadable files are skipped.
    packed: the folder is one of write_packed()."""
    if packed:
        files = read_packed(spark, path).where(F.rlike("value", F.lit(r"\A\s*\{")))
        parsed = files.select(F.substring_index("source_file", "/", -1).alias("session_file"), _row(F.col("value"), schema).alias("_row"))
        rows = parsed.where(f"_row.{BAD} is null").select("_row.*", "session_file").drop(BAD)
    else:
        rows = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").schema(schema).json(path).select("*", F.col("_metadata.file_name").alias("session_file"))
    return rows.where("version = 1 and messages is not null").orderBy(F.desc("updated_at_ms"), F.desc(tie)).limit(most)


def loadable_cards(cards: DataFrame, ident: str, injection: str, aliases: str, *more: str) -> DataFrame:
    """Cards with an id, an injection and an alias; alias lists are joined, in order and without repeats."""
    empty = F.array().cast("array<string>")
    every = F.array_distinct(F.filter(F.concat(*(F.coalesce(c, empty) for c in (aliases, *more))), lambda a: F.trim(a) != ""))
    return cards.withColumn(aliases, every).where((F.coalesce(ident, F.lit("")) != "") & (F.coalesce(injection, F.lit("")) != "") & (F.size(aliases) > 0))


def run_manifest(rows: DataFrame, split: str, group: str, seed: str, ratios: dict[str, float], hashes: DataFrame | None = None) -> DataFrame:
    """One row: seed, ratios, rows and groups of each split, and file hashes."""
    counts = rows.groupBy(split).agg(F.count("*").alias("n_rows"), F.count_distinct(group).alias("n_groups"))
    one = counts.agg(F.array_sort(F.collect_list(F.struct(split, "n_rows", "n_groups"))).alias("splits"), F.sum("n_rows").alias("total"))
    one = one.select(F.lit(seed).alias("seed"), F.create_map(*[F.lit(x) for kv in ratios.items() for x in kv]).alias("ratios"), "splits", "total")
    if hashes is None:
        return one
    return one.join(hashes.agg(F.array_sort(F.collect_list(F.struct("file", "sha256"))).alias("files")), F.lit(True))
