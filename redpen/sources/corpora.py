"""Corpus files as DataFrames: annotated blocks, tab-separated sentences, essays, JSON lines, synonyms."""

from __future__ import annotations

import json
import os
import shutil
import tarfile
import tomllib
import urllib.request
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.edits import EDIT, to_block
from ..functions.text import tokens

PAIR = "correct string, learner string, asked int"
TRAINING = (
    "source string, target string, edits array<struct<start:int,end:int,error_type:string,correction:string,"
    "rule:string,explanation:string,source_kind:string>>, source_kind string"
)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as (path, split, at, line), in the order of (split, at) in each
    file. Files are read in splits, so one of any size is many tasks."""
    rows = spark.read.text(path)
    meta = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split")]
    return rows.select(*meta, F.monotonically_increasing_id().alias("at"), F.rtrim(F.col("value"), F.lit("\r")).alias("line"))


def numbered(lines: DataFrame, counts: Column) -> DataFrame:
    """Lines with ``number``: how many lines that ``counts`` their file has up to each, itself
    included. Splits are counted, the counts summed over a file's splits, and lines numbered
    within their split."""
    one = F.when(counts, 1).otherwise(0)
    sizes = lines.groupBy("path", "split").agg(F.sum(one).alias("size"))
    before = F.sum("size").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    heads = sizes.select("path", "split", F.coalesce(before, F.lit(0)).alias("before"))
    inner = F.sum(one).over(Window.partitionBy("path", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("inner", inner).join(heads, ["path", "split"]).withColumn("number", F.col("before") + F.col("inner")).drop("before", "inner")


def read_m2(spark: SparkSession, path: str) -> DataFrame:
    """Annotated blocks as (path, sid, tokens, edits), sid from 0 in each file.

    A block starts at an ``S`` line, so a missing blank line between blocks does no
    harm. A malformed ``A`` line raises and names its file and text."""
    heads = F.startswith("line", F.lit("S ")) | (F.col("line") == "S")
    lines = numbered(lines_of(spark, path).where(heads | F.startswith("line", F.lit("A "))), heads).where("number > 0")
    body = F.array_sort(F.collect_list(F.struct("split", "at", "line")))
    blocks = lines.groupBy("path", (F.col("number") - 1).alias("sid")).agg(F.transform(body, lambda x: x["line"]).alias("block"))

    def parsed(line):
        parts = F.split(F.substring(line, 3, 1 << 30), "\\|\\|\\|", -1)
        span = F.split(parts[0], " ")
        edit = F.struct(
            span[0].cast("int").alias("start"), span[1].cast("int").alias("end"), parts[1].alias("error_type"), parts[2].alias("correction"), parts[5].cast("int").alias("annotator"), parts[3].alias("required"), parts[4].alias("comment")
        )
        return F.when((F.size(parts) < 6) | (F.size(span) != 2), F.raise_error(F.concat(F.col("path"), F.lit(": malformed edit: "), line)).cast(EDIT)).otherwise(edit)

    annotated = F.filter("block", lambda x: F.startswith(x, F.lit("A ")))
    return blocks.select("path", "sid", tokens(F.substring(F.col("block")[0], 3, 1 << 30)).alias("tokens"), F.transform(annotated, parsed).alias("edits"))


def write_m2(sentences: DataFrame, path: str) -> None:
    """A folder of files with blocks in the order of sid, from file to file, each followed by
    a blank line."""
    sentences.orderBy("sid").select(F.concat(to_block(F.col("tokens"), F.col("edits")), F.lit("\n")).alias("value")).write.text(path)


def read_tab_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(path, ordinal, sentence): the text after the first tab, trimmed, not empty; ordinals
    count a file's lines from 0."""
    rows = numbered(lines_of(spark, path), F.lit(True)).where(F.contains("line", F.lit("\t")))
    text = F.trim(F.substring("line", F.instr("line", "\t") + 1, F.lit(1 << 30)))
    return rows.select("path", (F.col("number") - 1).alias("ordinal"), text.alias("sentence")).where("sentence <> ''")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, ordinal, line), ordinals from 0."""
    return numbered(lines_of(spark, path), F.lit(True)).select("path", (F.col("number") - 1).alias("ordinal"), "line")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, PAIR)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, TRAINING)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Pairs as JSON lines, all fields written."""
    pairs.write.option("ignoreNullFields", False).json(path)


def already_done(asked: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left of a job that was stopped."""
    return asked.join(done.select(key).distinct(), key, "left_anti")


def fetched(name: str, url: str, folder: str, open_url=None, force: bool = False) -> str:
    """The place of a file that is fetched once: written beside it and renamed when whole, so a
    broken one is never taken for it. ``open_url`` opens a URL (urllib's by default)."""
    target = os.path.join(folder, name)
    if os.path.exists(target) and not force:
        return target
    os.makedirs(folder, exist_ok=True)
    with (open_url or urllib.request.urlopen)(url) as source, open(f"{target}.part", "wb") as sink:
        shutil.copyfileobj(source, sink)
    os.replace(f"{target}.part", target)
    return target


def unpacked(archive: str, folder: str) -> list[str]:
    """The files of a tar or zip archive, put into a folder; names that lead out of it raise."""
    os.makedirs(folder, exist_ok=True)
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            names = [i.filename for i in z.infolist() if not i.is_dir()]
            for n in names:
                if os.path.isabs(n) or ".." in n.split("/"):
                    raise ValueError(f"{n} leads out of the folder")
            z.extractall(folder)
    else:
        with tarfile.open(archive) as t:
            names = [m.name for m in t.getmembers() if m.isfile()]
            t.extractall(folder, filter="data")
    return sorted(os.path.join(folder, n) for n in names)


def sentences_file(folder: str) -> str:
    """The one file of sentences in a folder; none or several raise."""
    found = [os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if f.endswith("-sentences.txt")]
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} files of sentences in {folder}")
    return found[0]


def split_files(folder: str, corpus: str, suffix: str = ".m2") -> dict[str, str]:
    """The files of a corpus' splits by name, those that are there."""
    paths = {s: os.path.join(folder, f"{corpus}-{s}{suffix}") for s in ("train", "dev", "test")}
    return {s: p for s, p in paths.items() if os.path.exists(p)}


def load_config(path: str) -> dict:
    """A configuration in JSON or TOML, or in YAML where its library is installed."""
    with open(path, "rb") as f:
        if path.endswith(".json"):
            return json.load(f)
        if path.endswith(".toml"):
            return tomllib.load(f)
        import yaml

        return yaml.safe_load(f)


def read_essays(spark: SparkSession, path: str) -> DataFrame:
    """Essay rows with prompt and quarter from the file's name; white space collapsed;
    rows without id or essay go."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    squeeze = lambda c: F.trim(F.regexp_replace(F.col(c), "(?U)\\s+", " "))
    name = F.split(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1), "\\.")
    rows = rows.select(*[squeeze(c).alias(c) for c in ("id", "essay", "corrected1", "corrected2")], name[0].alias("prompt"), name[1].alias("quarter"))
    return rows.where("id <> '' and essay <> ''")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_checker_cache(spark: SparkSession, path: str) -> DataFrame:
    """The last well-formed entry of each key, by file and line."""
    rows = lines_of(spark, path).withColumn("r", F.from_json("line", "key string, text string, matches string")).where("r.key is not null")
    place = F.struct("path", "split", "at")
    return rows.groupBy("r.key").agg(F.max_by("r.text", place).alias("text"), F.max_by("r.matches", place).alias("matches"))


def append_checker_cache(fresh: DataFrame, path: str) -> None:
    """New entries (key, text, matches) added to a cache folder."""
    fresh.select("key", "text", "matches").write.mode("append").json(path)


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """Edges (word, synonym) of ``;``-separated sets: lower case, annotations in brackets
    dropped, no entries of several words, no ``#`` lines."""
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#")))
    words = F.transform(F.split("value", ";"), lambda w: F.lower(F.trim(F.regexp_replace(w, "\\([^)]*\\)", ""))))
    words = F.array_distinct(F.filter(words, lambda w: (w != "") & ~F.contains(w, F.lit(" "))))
    sets = rows.select(words.alias("words"))
    edges = sets.select(F.explode("words").alias("word"), "words").select("word", F.explode("words").alias("synonym"))
    return edges.where("word <> synonym").distinct()
