"""Log files as one row a line, with their order, and what couldn't be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Which files of a folder a producer's adapter takes (fixed values): a pattern of names, a part that the path must have, one that it must not.
ADAPTERS = {"claude-code": ("*.jsonl", None, "/subagents/"), "codex": ("rollout-*.jsonl", None, None), "gemini": ("*.jsonl", "/chats/", None)}


def list_files(spark: SparkSession, root: str, source: str) -> DataFrame:
    """(file, mtime_ms, size) of an adapter's files below ``root``; empty files are left out. Contents aren't read."""
    glob, must, must_not = ADAPTERS[source]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    found = found.where("length > 0").select(F.col("path").alias("file"), F.unix_millis(F.col("modificationTime")).alias("mtime_ms"), F.col("length").alias("size"))
    if must:
        found = found.where(F.contains("file", F.lit(must)))
    return found.where(~F.contains("file", F.lit(must_not))) if must_not else found


def read_lines(spark: SparkSession, root: str, source: str) -> DataFrame:
    """(file, line_no, line) of all lines that aren't blank. A file is one row on its way to lines, so its lines keep their order."""
    glob, must, must_not = ADAPTERS[source]
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    if must:
        whole = whole.where(F.contains("file", F.lit(must)))
    if must_not:
        whole = whole.where(~F.contains("file", F.lit(must_not)))
    lines = whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return lines.where(F.length(F.trim("line")) > 0).withColumn("line_no", F.col("line_no").cast("long"))


def is_json(line: Column) -> Column:
    return F.try_parse_json(line).isNotNull() & line.rlike(r"^\s*\{")


def split_bad(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines that are JSON objects, and per file how many weren't."""
    marked = lines.withColumn("_ok", is_json(F.col("line")))
    bad = marked.groupBy("file").agg(F.sum((~F.col("_ok")).cast("long")).alias("dropped_records"))
    return marked.where("_ok").drop("_ok"), bad


def first_lines(lines: DataFrame) -> DataFrame:
    """Each file's first line: what a listing needs without the rest."""
    return lines.groupBy("file").agg(F.min_by("line", "line_no").alias("line"))


def changed_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose (mtime, size) the manifest doesn't hold: those to read again; the others' summaries stay valid."""
    return listing.join(manifest.select("file", "mtime_ms", "size"), ["file", "mtime_ms", "size"], "left_anti")


def merge_summaries(kept: DataFrame, fresh: DataFrame, listing: DataFrame) -> DataFrame:
    """The summaries of all files that are still there, fresh ones in place of old ones. Degraded ones aren't kept over."""
    old = kept.where("not degraded").join(fresh.select("file"), "file", "left_anti")
    return old.unionByName(fresh).join(listing.select("file").distinct(), "file", "left_semi")


def numbered_in_file(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumn(name, (F.row_number().over(W.partitionBy("file").orderBy("line_no")) - 1).cast("long"))
