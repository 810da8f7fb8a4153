"""Unified diffs as rows: hunks, their places by running sums, their old lines joined with the files' lines.

A hunk begins where its header says, moved by what the headers before it add.  As long as each hunk lies after those
before it, the line that it begins at is one of the file as it was: the place less what the hunks before really
add.  So all old lines of all hunks of all files are checked by one equi-join, the lines that no hunk covers are kept by
another, and new lines take their place by the order of both.  Diffs whose hunks go back or overlap are left to the
fold of ``patch``, which changes a text hunk by hunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import shared
from ..functions import text
from . import patch

#: Fixed value: a hunk's header.
HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)$"


def hunk_rows(diffs: DataFrame) -> DataFrame:
    """(path, hunk, n, at, grows, mark, line) of every line of every hunk of diffs (path, diff); n ascends within a diff.

    grows is what the header's counts add; mark is ' ', '-' or '+'.  A heading after the header is a line of context, lines
    without a mark are too, and what follows the names of another file isn't read until the next header.  A
    hunk without lines has one row of null mark.
    """
    rows = diffs.select("path", F.posexplode(text.split_lines(F.coalesce("diff", F.lit("")))).alias("n", "said"))
    part = lambda i: F.regexp_extract("said", HEADER, i)
    head = F.col("said").rlike(HEADER)
    count = lambda i: F.coalesce(part(i).try_cast("long"), F.lit(1))
    by = W.partitionBy("path").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"head": head, "hunk": F.sum(head.cast("int")).over(by)}).where("hunk > 0")
    within = W.partitionBy("path", "hunk").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    named = ~F.col("head") & (F.col("said").startswith("---") | F.col("said").startswith("+++"))
    at = part(1).try_cast("long")
    rows = rows.withColumns({"left": F.max(named).over(within), "at": F.first(at).over(within), "grows": F.first(count(4) - count(2)).over(within)})
    heading = F.trim(F.regexp_replace(part(5), r"(?U)^\s+|\s+$", ""))
    marked = F.col("said").rlike("^[ +-]")
    mark = F.when(F.col("head"), F.when(heading != "", " ")).otherwise(F.when(marked, F.substring("said", 1, 1)).otherwise(" "))
    line = F.when(F.col("head"), heading).otherwise(F.when(marked, F.expr("substring(said, 2)")).otherwise(F.col("said")))
    return rows.where(F.col("head") | (~F.col("left") & ~F.col("said").startswith("\\"))).select("path", "hunk", "n", "at", "grows", mark.alias("mark"), line.alias("line"))


def placed(rows: DataFrame) -> DataFrame:
    """(path, hunk, first, origin, old, plain) of hunk_rows: the line from 0 that each hunk begins at in the text as it is then, and in the file.

    plain tells whether all hunks of the path lie one after the other.
    """
    hunks = rows.groupBy("path", "hunk").agg(F.first("at").alias("at"), F.first("grows").alias("grows"), F.count(F.when(F.col("mark") != "+", 1)).alias("old"), F.count(F.when(F.col("mark") != "-", 1)).alias("new"))
    before = W.partitionBy("path").orderBy("hunk").rowsBetween(W.unboundedPreceding, -1)
    moved = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    hunks = hunks.withColumn("first", F.col("at") + moved("grows") - 1).withColumn("origin", F.col("first") - moved(F.col("new") - F.col("old")))
    follows = F.col("origin") >= F.coalesce(F.lag(F.col("origin") + F.col("old")).over(W.partitionBy("path").orderBy("hunk")), F.lit(-(1 << 62)))
    return hunks.withColumn("plain", F.min(follows).over(W.partitionBy("path"))).select("path", "hunk", "first", "origin", "old", "plain")


def _file_lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(text.split_lines(F.coalesce("code", F.lit("")))).alias("i", "have"))


def apply_diffs(files: DataFrame, diffs: DataFrame) -> DataFrame:
    """(path, patched, error) of files (path, code) that have a diff (path, diff), as patch.patched tells them; paths are unique."""
    both = files.join(diffs.select("path", "diff"), "path")
    rows = shared.table(hunk_rows(diffs), "hunk_rows")
    at = shared.table(placed(rows), "hunks")
    plain = at.where("plain").drop("plain")
    old_place = F.row_number().over(W.partitionBy("path", "hunk").orderBy("n")) - 1
    old = rows.where("mark in (' ', '-')").withColumn("k", old_place).join(plain, ["path", "hunk"]).select("path", "hunk", "k", "line", (F.col("origin") + F.col("k")).alias("i"), (F.col("first") + F.col("k") + 1).alias("now"))
    lines = _file_lines(files.join(plain.select("path").distinct(), "path", "left_semi"))
    checked = old.join(lines, ["path", "i"], "left").where("not (line <=> have)")
    wrong = F.when(F.col("have").isNull(), F.concat(F.lit("hunk wants line "), "now", F.lit(", past the end"))).otherwise(F.concat(F.lit("hunk mismatch at line "), "now"))
    size = files.select("path", F.size(text.split_lines(F.coalesce("code", F.lit("")))).alias("size"))
    outside = plain.join(size, "path").where("origin < 0 or first < 0 or origin > size").select("path", "hunk", F.lit(-1).alias("k"), F.concat(F.lit("hunk starts at line "), F.col("first") + 1, F.lit(", outside the file")).alias("error"))
    # the first thing wrong, as hunks are applied in order
    failed = checked.select("path", "hunk", "k", wrong.alias("error")).unionByName(outside).groupBy("path").agg(F.min_by("error", F.struct("hunk", "k")).alias("error"))
    failed = shared.table(failed, "failed")
    fine = plain.join(failed, "path", "left_anti")
    covered = old.select("path", "i").distinct()
    kept = lines.join(failed, "path", "left_anti").join(covered, ["path", "i"], "left_anti").select("path", F.struct(F.col("i").cast("long").alias("i"), F.lit(1).alias("own"), F.lit(0).alias("n")).alias("key"), F.col("have").alias("line"))
    new = rows.where("mark in (' ', '+')").join(fine, ["path", "hunk"]).select("path", F.struct(F.col("origin").alias("i"), F.lit(0).alias("own"), "n").alias("key"), "line")
    joined = kept.unionByName(new).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "line"))), lambda r: r["line"]), "\n").alias("text"))
    ended = F.when(F.col("code").endswith("\n"), "\n").otherwise("")
    done = both.join(fine.select("path").distinct(), "path", "left_semi").join(joined, "path", "left").select("path", F.concat(F.coalesce("text", F.lit("")), ended).alias("patched"), F.lit(None).cast("string").alias("error"))
    bad = failed.select("path", F.lit(None).cast("string").alias("patched"), "error")
    rest = both.join(plain.select("path").distinct(), "path", "left_anti").select("path", patch.patched("code", "diff").alias("p")).select("path", "p.patched", "p.error")
    return done.unionByName(bad.join(files.select("path"), "path", "left_semi")).unionByName(rest)
