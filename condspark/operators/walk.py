"""Depth-first walks over active includes: who is visited, in which order, and the graph that this leaves.

A walk opens each file once, at its first visit, and goes no deeper than a bound, so a file first met near the bound
isn't opened again on a shorter way.  A visit's label is the list of line numbers of the includes on the way to it; walks
meet files in the labels' order.  A file's label is the least among its visited includers' labels with the include's
line at the end, of those within the bound.  That has one solution, which rounds of relabelling reach: what
is right for the first visits of a walk stays right, and makes the next one right.

Walks whose labels no longer change are closed and leave the rounds.  All walks of all roots and targets go on at once;
the order is never told by a loop over files.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import shared
from ..functions import text
from . import includes

SKIPPED = " [skipped]"


def first_visits(edges: DataFrame, roots: DataFrame, walk: list[str], by: list[str], max_depth: int | None = None) -> DataFrame:
    """(walk, node, label) of every node that each walk visits; a root's label is empty.

    roots: (walk, node), one root for each walk; edges: (by, src, ord, dst), ``by`` being those of the walk's columns that its
    edges depend on.  A node's children are met by ascending ord.  Labels have fewer than ``max_depth`` places.
    """
    steps = shared.table(edges.groupBy(*by, "src", "dst").agg(F.min("ord").alias("ord")), "steps")
    none = F.array().cast("array<int>")
    start = roots.select(*walk, "node", none.alias("label"))
    front, closed = shared.table(start, "front"), []
    begin = front
    within = F.lit(True) if max_depth is None else F.size("label") + 1 < max_depth
    while True:
        ways = front.where(within).withColumnRenamed("node", "src").join(steps, [*by, "src"])
        met = ways.groupBy(*walk, F.col("dst").alias("node")).agg(F.min(F.concat("label", F.array(F.col("ord").cast("int")))).alias("label"))
        # a root is visited before all
        new = begin.unionByName(met).groupBy(*walk, "node").agg(F.min("label").alias("label"))
        both = new.join(front.withColumnRenamed("label", "before"), [*walk, "node"], "full")
        moved = ~F.coalesce(F.col("label") == F.col("before"), F.lit(False))
        # as many rows a walk as it visits files
        told = both.select(*walk, "node", "label", F.max(moved).over(W.partitionBy(*walk)).alias("open")).where("label is not null or open")
        told = shared.table(told, "labels")
        closed.append(told.where("not open").drop("open"))
        still = told.where("open")
        if still.isEmpty():
            break
        front = still.where("label is not null").drop("open")
        begin = front.where(F.size("label") == 0)
    out = closed[0]
    for part in closed[1:]:
        out = out.unionByName(part)
    return out


class Walk(NamedTuple):
    """visits: (root, target, path, label, depth).  events: (root, target, path, line_no, header, active, dst, label), the
    includes met, in the labels' order.  errors: (root, target, path, line_no, error), where a walk ended early.
    """

    visits: DataFrame
    events: DataFrame
    errors: DataFrame


def walk(files: DataFrame, dirs: DataFrame, roots: DataFrame, targets: DataFrame, max_depth: int = 10) -> Walk:
    """Depth-first walks from each root for each target over active includes, as includes.walker_events tells them.

    files: (path, code); dirs as in includes.resolve; roots: (root, target); targets: (target, macros).  Files at
    max_depth aren't visited; roots that are no file have no walk.  A condition that can't be evaluated ends the walk
    that meets it, at that place in its order; what came before stays, other walks go on.  Null code has no lines.
    """
    lines = placed(told_lines(files, targets), files, dirs)
    begin = roots.join(files.select(F.col("path").alias("root")).distinct(), "root", "left_semi").distinct()
    return walk_lines(lines, begin, max_depth)


def told_lines(files: DataFrame, targets: DataFrame) -> DataFrame:
    """(path, target, line_no, header, active, error) of every file for every target."""
    return includes.walker_events(files.select("path", "code").crossJoin(F.broadcast(targets.select("target", "macros"))))


def placed(lines: DataFrame, files: DataFrame, dirs: DataFrame) -> DataFrame:
    """lines with dst, the file that each header is, as a written table."""
    headers = lines.where("header is not null").select("path", "line_no", "header").distinct()
    return shared.table(lines.join(includes.resolve(headers, files, dirs), ["path", "line_no", "header"], "left"), "events")


def walk_lines(lines: DataFrame, roots: DataFrame, max_depth: int) -> Walk:
    """walk from roots (root, target) that are files, over what placed gave."""
    follow = lines.where("active and dst is not null").select("target", F.col("path").alias("src"), F.col("line_no").alias("ord"), "dst")
    begin = roots.select("root", "target") if max_depth > 0 else roots.select("root", "target").limit(0)
    labels = first_visits(follow, begin.withColumn("node", F.col("root")), ["root", "target"], ["target"], max_depth).withColumnRenamed("node", "path")
    labels = shared.table(labels, "visits")
    at = F.concat("label", F.array("line_no"))
    told = shared.table(labels.join(lines, ["target", "path"]).withColumn("label", at), "told")
    bad = told.where("error is not null").groupBy("root", "target").agg(F.min(F.struct("label", "path", "line_no", "error")).alias("e"))
    bad = shared.table(bad.select("root", "target", F.col("e.label").alias("end"), "e.path", "e.line_no", "e.error"), "errors")
    ends = bad.select("root", "target", "end")
    until = lambda rows: rows.join(ends, ["root", "target"], "left").where(F.col("end").isNull() | (F.col("label") < F.col("end"))).drop("end")
    visits = until(labels).select("root", "target", "path", "label", F.size("label").alias("depth"))
    events = until(told.where("error is null")).select("root", "target", "path", "line_no", "header", "active", "dst", "label")
    return Walk(visits, events, bad.drop("end"))


def followed(walked: Walk) -> DataFrame:
    """(root, target, path): headers that were unvisited when an active include named them, those at the bound included."""
    return walked.events.where("active and dst is not null and dst <> root").select("root", "target", F.col("dst").alias("path")).distinct()


def name_graph(walked: Walk) -> DataFrame:
    """(root, target, name, path, first, deps): what a graph keyed by file name holds after the walk.

    Each visit of a file of a name empties the name's list, so of files that share one the last visited stands, with
    what was met in any of them afterwards.  deps are headers as written, in order, with a mark where they were skipped;
    first is the label by which the name came in.
    """
    name = text.basename(F.col("path"))
    last = walked.visits.groupBy("root", "target", name.alias("name")).agg(F.max("label").alias("last"), F.max_by("path", "label").alias("path"), F.min("label").alias("first"))
    said = F.concat("header", F.when(F.col("active"), "").otherwise(SKIPPED))
    events = walked.events.select("root", "target", name.alias("name"), "label", said.alias("dep"))
    kept = last.select("root", "target", "name", "last").join(events, ["root", "target", "name"]).where("label > last")
    lists = kept.groupBy("root", "target", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "dep"))), lambda x: x["dep"]).alias("deps"))
    out = last.drop("last").join(lists, ["root", "target", "name"], "left")
    return shared.table(out.withColumn("deps", F.coalesce("deps", F.array().cast("array<string>"))), "names")


def _by_name(graph: DataFrame) -> DataFrame:
    """(root, target, name, label, deps): names that the root's name leads to, in the order of a stack that takes the last first."""
    edges = graph.select("root", "target", F.col("name").alias("src"), F.posexplode("deps").alias("i", "dst")).withColumn("ord", -F.col("i"))
    begin = graph.select("root", "target").distinct().withColumn("node", text.basename(F.col("root")))
    seen = first_visits(edges.drop("i"), begin, ["root", "target"], ["root", "target"]).withColumnRenamed("node", "name")
    return seen.join(graph.select("root", "target", "name", "deps"), ["root", "target", "name"], "left")


def _in_order(rows: DataFrame, value: Column, key: str = "label") -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(key), value.alias("v")))), lambda x: x["v"])


def graph_json(graph: DataFrame) -> DataFrame:
    """(root, target, json): root, nodes and edges that the root's name leads to; a header as written is a node of its own."""
    seen = _by_name(graph)
    links = F.transform(F.coalesce("deps", F.array().cast("array<string>")), lambda d: F.struct(F.col("name").alias("from"), d.alias("to")))
    out = seen.groupBy("root", "target").agg(_in_order(seen, F.col("name")).alias("nodes"), F.flatten(_in_order(seen, links)).alias("edges"))
    return out.select("root", "target", F.to_json(F.struct(text.basename(F.col("root")).alias("root"), "nodes", "edges")).alias("json"))


def graph_stats(graph: DataFrame) -> DataFrame:
    """(root, target, total_files, max_depth, total_edges): names reached and their depth; edges of all names."""
    reached = _by_name(graph).groupBy("root", "target").agg(F.count("*").alias("total_files"), F.max(F.size("label")).cast("long").alias("max_depth"))
    edges = graph.groupBy("root", "target").agg(F.sum(F.size("deps")).alias("total_edges"))
    return reached.join(edges, ["root", "target"])


#: The lines of a drawn graph.
DOT_TOP = ["digraph G {", '  rankdir="LR";', "  node [shape=box];"]
DOT_ROOT, DOT_EDGE, DOT_OPEN = ' [style=filled, fillcolor=lightblue];', " -> ", " [style=dashed];"


def graph_dot(graph: DataFrame) -> DataFrame:
    """(root, target, dot): names as they came in, their headers in order, then names that no file visited has, sorted."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    arrows = F.transform("deps", lambda d: F.concat(F.lit("  "), quoted(F.col("name")), F.lit(DOT_EDGE), quoted(d), F.lit(";")))
    drawn = graph.groupBy("root", "target").agg(F.flatten(_in_order(graph, arrows, "first")).alias("arrows"), F.array_sort(F.array_except(F.array_distinct(F.flatten(F.collect_list("deps"))), F.collect_set("name"))).alias("open"))
    root = F.concat(F.lit("  "), quoted(text.basename(F.col("root"))), F.lit(DOT_ROOT))
    dashed = F.transform("open", lambda n: F.concat(F.lit("  "), quoted(n), F.lit(DOT_OPEN)))
    lines = F.concat(F.array(*map(F.lit, DOT_TOP), root), F.col("arrows"), dashed, F.array(F.lit("}")))
    return drawn.select("root", "target", F.array_join(lines, "\n").alias("dot"))
