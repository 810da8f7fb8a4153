"""Source trees, build databases and settings as DataFrames; writers of results (see projects for finding them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text

ENTRY = "directory string, file string, command string, arguments array<string>, output string"


def source_files(spark: SparkSession, path: str, glob: str = "*.{c,cc,cpp,cxx,C,h,hpp}") -> DataFrame:
    """(path, code) of a tree; bytes that aren't UTF-8 become the replacement character."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    local = F.regexp_replace("path", "^[a-z]+:/+", "/")
    return files.select(local.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("code"))


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """(db_id, entry_ord, directory, file, command, arguments) in file order."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("db_id"), F.from_json("value", f"array<struct<{ENTRY.replace(' string', ':string').replace(' array<string>', ':array<string>')}>>").alias("entries"))
    return raw.select("db_id", F.posexplode("entries").alias("entry_ord", "e")).select("db_id", "entry_ord", "e.directory", "e.file", "e.command", "e.arguments")


_parsed: dict[str, tuple[int, DataFrame]] = {}
#: Fixed value: how many databases stay parsed.
KEPT = 16


def cached_commands(spark: SparkSession, path: str) -> DataFrame:
    """compile_commands of one file, kept until the file changes; of more than KEPT the one changed longest ago goes."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    changed = file.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(file).getModificationTime()
    known = _parsed.get(path)
    if known and known[0] == changed and known[1].sparkSession is spark:
        return known[1]
    if known:
        known[1].unpersist()
    elif len(_parsed) >= KEPT:
        _parsed.pop(min(_parsed, key=lambda p: _parsed[p][0]))[1].unpersist()
    _parsed[path] = changed, compile_commands(spark, path).cache()
    return _parsed[path][1]


def settings(texts: DataFrame) -> DataFrame:
    """(project, key, value) of rc texts (project, text): sections prefix keys, '#' begins a comment."""
    rows = texts.select("project", F.posexplode(text.split_lines(F.col("text"))).alias("n", "line"))
    rows = rows.withColumn("line", F.trim(F.regexp_replace("line", r"#.*$", "")))
    section = F.regexp_extract("line", r"^\[([^\]]+)\]$", 1)
    by = W.partitionBy("project").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.coalesce(F.last(F.when(section != "", F.trim(section)), ignorenulls=True).over(by), F.lit("pruner")))
    pair = rows.where("line like '%=%'").select("project", "n", F.concat(F.col("section"), F.lit("."), F.trim(F.substring_index("line", "=", 1))).alias("key"), F.trim(F.expr("substring(line, locate('=', line) + 1)")).alias("value"))
    return pair.groupBy("project", "key").agg(F.max_by("value", "n").alias("value"))


def coerced(value):
    """(kind, value) of a setting: bool, list, int, float, or string without its quotes."""
    v = F.trim(value)
    low = F.lower(v)
    quoted = v.rlike(r"""^".*"$|^'.*'$""") & (F.length(v) >= 2)
    return F.struct(
        F.when(low.isin("true", "yes", "on", "false", "no", "off"), "bool").when(v.rlike(r"^\[.*\]$"), "list").when(v.rlike(r"^[+-]?\d+(_\d+)*$"), "int")
        .when(v.rlike(r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^[+-]?(inf|infinity|nan)$"), "float").otherwise("string").alias("kind"),
        F.when(low.isin("true", "yes", "on"), "true").when(low.isin("false", "no", "off"), "false").when(quoted, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v).alias("value"),
    )


def database_path(projects: DataFrame, listing: DataFrame) -> DataFrame:
    """(project, path): the configured database if it exists, with none configured the first default that does.

    projects: (project, root, configured); listing: (path).
    """
    tried = projects.select("project", F.posexplode(F.when(F.coalesce("configured", F.lit("")) != "", F.array(text.resolve(F.col("configured"), F.col("root")))).otherwise(
        F.array(F.concat("root", F.lit("/build/compile_commands.json")), F.concat("root", F.lit("/compile_commands.json"))))).alias("n", "path"))
    found = tried.join(listing.select("path").distinct(), "path").groupBy("project").agg(F.min_by("path", "n").alias("path"))
    return projects.select("project").join(found, "project", "left")


def read_parts(spark: SparkSession, path: str, lines: int = 10_000) -> DataFrame:
    """(path, part, code) of files of any size, a row for each run of lines of a split, parts ascending within a file.

    Splits are those that Spark reads text by (spark.sql.files.maxPartitionBytes), so no task holds a file.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    first = rows.groupBy("path", "block").agg(F.min("at").alias("first"))
    run = rows.join(F.broadcast(first), ["path", "block"]).withColumn("run", F.expr(f"(at - first) div {lines}"))  # a row a split
    parts = run.groupBy("path", "block", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda r: r["value"]), "\n").alias("code"))
    parts = parts.withColumn("code", F.concat("code", F.lit("\n")))
    return parts.select("path", F.expr("block * 4096 + run").alias("part"), "code")


def write_texts(df: DataFrame, path: str, force: bool = False) -> None:
    """(path, code) as Parquet; an existing result is replaced only by force, never changed in place."""
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)
