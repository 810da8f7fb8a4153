"""Include graphs: edges, resolution, bounded closure, statistics and exports."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared
from ..functions import conditions, text
from . import blocks


def include_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, header) of every include."""
    rows = blocks.lines(files.select("path", "code"))
    header = F.regexp_extract("text", blocks.INCLUDE, 1)
    return rows.select("path", "line_no", header.alias("header")).where("header <> ''")


def resolve(edges: DataFrame, files: DataFrame, dirs: DataFrame) -> DataFrame:
    """edges (path, line_no, header) with dst: the first that is a file of absolute name, includer's folder, dirs.

    dirs: (ord, dir), the include folders in order; headers found nowhere have a null dst.
    """
    listed = dirs.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "dir"))), lambda d: d["dir"]).alias("dirs"))
    with_dirs = edges.join(F.broadcast(listed))  # one row
    places = F.when(F.col("header").startswith("/"), F.array("header")).otherwise(
        F.concat(F.array(F.concat(text.dirname(F.col("path")), F.lit("/"), F.col("header"))), F.transform("dirs", lambda d: F.concat(d, F.lit("/"), F.col("header"))))
    )
    tried = with_dirs.select("path", "line_no", "header", F.posexplode(places).alias("n", "place")).withColumn("place", text.normal_path(F.col("place")))
    found = tried.join(files.select(F.col("path").alias("place")).distinct(), "place").groupBy("path", "line_no", "header").agg(F.min_by("place", "n").alias("dst"))
    return edges.join(found, ["path", "line_no", "header"], "left")


def closure(edges: DataFrame, roots: DataFrame, max_depth: int = 10) -> DataFrame:
    """(root, path, depth): what each root reaches at its least depth, a root being at depth 0.

    Semi-naive: only paths new in a round go on, so cycles end; files from depth max_depth on
    aren't opened.  edges: (src, dst).  Each round is a written table, so plans stay small at any depth.
    """
    edges = shared.table(edges.where("dst is not null").select("src", "dst").distinct(), "edges")
    seen = front = shared.table(roots.select("root", F.col("root").alias("path"), F.lit(0).alias("depth")).distinct(), "front")
    for depth in range(1, max_depth):
        step = front.join(edges, front["path"] == edges["src"]).select("root", F.col("dst").alias("path")).distinct()
        front = shared.table(step.join(seen.select("root", "path"), ["root", "path"], "left_anti").withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def active_includes(files: DataFrame) -> DataFrame:
    """(path, target, line_no, header, active): includes that lie in active blocks.

    files: (path, target, macros, code).  Branches are told as pruning tells them.
    """
    states = blocks.line_states(files)
    header = F.regexp_extract("text", blocks.INCLUDE, 1)
    return states.where(header != "").select("path", "target", "line_no", header.alias("header"), "active")


def _loose(events: list[tuple[str | None, str | None]], truth) -> tuple[list[bool], int, str | None]:
    """(whether each include, a null directive, is followed; how many events were read; the error that ended them).

    Branches forget what was taken: a branch is on where the one before it was off and its condition holds, so an else
    after an elif that switched the chain off is on again; elif is asked only where the blocks around it are on,
    if, ifdef and ifndef everywhere.  The first condition that can't be evaluated ends the file.
    """
    found, chain = [], []
    for n, (word, condition) in enumerate(events):
        outer = all(chain[:-1])
        asked = word in ("if", "ifdef", "ifndef") or (word == "elif" and chain and outer)
        yes, error = truth(condition) if asked else (False, None)
        if error is not None:
            return found, n, error
        if word is None:
            found.append(all(chain))
        elif word in ("if", "ifdef", "ifndef"):
            chain.append(all(chain) and (yes != (word == "ifndef")))
        elif chain and word == "elif" and outer:
            chain[-1] = not chain[-1] and yes
        elif chain and word == "else":
            chain[-1] = outer and not chain[-1]
        elif chain and word == "endif":
            chain.pop()
    return found, len(events), None


@F.arrow_udf(T.StructType().add("on", T.ArrayType(T.BooleanType())).add("read", T.IntegerType()).add("error", T.StringType()))
def _loosely(events: pa.Array, key: pa.Array) -> pa.Array:
    memo = conditions.Memo()
    keys = blocks.shared_texts(key)
    out = []
    for i, j in blocks.slices([n + 1 for n in events.value_lengths().to_pylist()], blocks.HELD):
        rows = zip(blocks.asked_rows(events[i:j], ("directive", "condition")), keys[i:j], strict=True)
        told = [_loose(found, partial(memo.told, key=k)) for found, k in rows]
        on = pa.ListArray.from_arrays(blocks.offsets_of([len(t[0]) for t in told]), pa.array([x for t in told for x in t[0]], pa.bool_()))
        out.append(pa.StructArray.from_arrays([on, pa.array([t[1] for t in told], pa.int32()), pa.array([t[2] for t in told], pa.string())], ["on", "read", "error"]))
    return pa.concat_arrays(out) if out else pa.array([], pa.struct({"on": pa.list_(pa.bool_()), "read": pa.int32(), "error": pa.string()}))


def walker_events(files: DataFrame) -> DataFrame:
    """(path, target, line_no, header, active, error): a file's includes as the include walker tells branches, see _loose.

    files: (path, target, macros, code).  It differs from active_includes in chains with #elif, and in a condition that
    can't be evaluated: that is the file's last row, with an error and without a header.  No step shuffles.
    """
    marked = blocks.marked_lines(text.split_lines(F.coalesce("code", F.lit(""))))
    directive = lambda m, c: F.when(m["word"] != "", c)  # noqa: E731  no line is both
    lines = F.transform(marked, lambda m: F.struct((m["at"] + 1).alias("line_no"), directive(m, m["word"]).alias("directive"), directive(m, blocks._condition(m["x"])).alias("condition"), F.when(m["word"] == "", F.regexp_extract(m["x"], blocks.INCLUDE, 1)).alias("header")))
    rows = files.withColumn("_e", F.filter(lines, lambda e: e["directive"].isNotNull() | (e["header"] != "")))
    asked = F.transform("_e", lambda e: F.struct(e["directive"].alias("directive"), e["condition"].alias("condition")))
    rows = rows.withColumn("_s", _loosely(asked, conditions.macro_key(F.col("macros"))))
    read = F.filter(F.slice("_e", F.lit(1), F.col("_s.read")), lambda e: e["directive"].isNull())
    told = F.zip_with(read, F.col("_s.on"), lambda e, on: F.struct(e["line_no"].alias("line_no"), e["header"].alias("header"), on.alias("active"), F.lit(None).cast("string").alias("error")))
    end = F.struct(F.get("_e", F.col("_s.read"))["line_no"].alias("line_no"), F.lit(None).cast("string").alias("header"), F.lit(False).alias("active"), F.col("_s.error").alias("error"))
    last = F.filter(F.array(end), lambda e: e["error"].isNotNull())
    return rows.select("path", "target", F.explode_outer(F.concat(told, last)).alias("r")).where("r is not null").select("path", "target", "r.*")


def walked_includes(files: DataFrame) -> DataFrame:
    """(path, target, line_no, header, active): walker_events without errors; a file is read up to its first bad condition."""
    return walker_events(files).where("error is null").drop("error")


def conditional_closure(files: DataFrame, dirs: DataFrame, roots: DataFrame, targets: DataFrame, max_depth: int = 10, walker: bool = True) -> tuple[DataFrame, DataFrame]:
    """What each root reaches for each target by active includes alone, and the includes met on the way.

    files: (path, code); dirs as in resolve; roots: (root, target); targets: (target, macros).  The first
    result is (root, target, path, depth), at the least depth, a root being at depth 0; a root that
    is no file reaches nothing.  Only paths new in a round go on, so cycles end; files at max_depth are
    reached, not opened.  The second is (root, target, path, line_no, header, active, dst) of every
    include of the opened files: skipped ones aren't active, those found nowhere have a null dst.  Branches are
    told by walked_includes, or as pruning tells them where ``walker`` is off.
    """
    states = (walked_includes if walker else active_includes)(files.select("path", "code").crossJoin(F.broadcast(targets.select("target", "macros"))))
    edges = shared.table(states.join(resolve(include_lines(files), files, dirs).distinct(), ["path", "line_no", "header"], "left"), "includes")
    follow = edges.where("active and dst is not null").select("target", F.col("path").alias("src"), "dst").distinct()
    begin = roots.join(files.select(F.col("path").alias("root")), "root", "left_semi").select("root", "target", F.col("root").alias("path"), F.lit(0).alias("depth"))
    seen = front = shared.table(begin.distinct(), "front")
    for depth in range(1, max_depth + 1):
        step = front.select("root", "target", F.col("path").alias("src")).join(follow, ["target", "src"]).select("root", "target", F.col("dst").alias("path")).distinct()
        # written, as each round asks for all before it
        front = shared.table(step.join(seen.select("root", "target", "path"), ["root", "target", "path"], "left_anti").withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    opened = seen.where(F.col("depth") < max_depth).select("root", "target", "path")
    return seen, opened.join(edges, ["target", "path"]).select("root", "target", "path", "line_no", "header", "active", "dst")


def rooted(edges: DataFrame, reached: DataFrame, max_depth: int = 10) -> DataFrame:
    """(root, src, dst): the includes met on the way from each root, for exports.

    reached: what closure with the same max_depth gave; files at max_depth - 1 are reached, not opened.
    """
    opened = reached.where(F.col("depth") < max_depth - 1)
    return opened.join(edges.where("dst is not null").select("src", "dst").distinct(), opened["path"] == F.col("src")).select("root", "src", "dst")


def graph_stats(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(root, total_files, max_depth, total_edges)."""
    inside = reached.join(edges.select("src", "dst").distinct(), reached["path"] == edges["src"], "left")
    return inside.groupBy("root").agg(F.countDistinct("path").alias("total_files"), F.max("depth").cast("long").alias("max_depth"), F.count("dst").alias("total_edges"))


def to_json(edges: DataFrame) -> DataFrame:
    """(root, json): nodes sorted and edges as one document for each root; edges: (root, src, dst)."""
    nodes = F.array_sort(F.array_distinct(F.concat(F.collect_set("src"), F.collect_set("dst"))))
    links = F.array_sort(F.collect_set(F.struct("src", "dst")))
    return edges.groupBy("root").agg(F.to_json(F.struct(nodes.alias("nodes"), links.alias("edges"))).alias("json"))


def to_dot(edges: DataFrame) -> DataFrame:
    """(root, dot): the graph in the DOT language."""
    arrow = F.concat(F.lit("  "), text.dot_quote(F.col("src")), F.lit(" -> "), text.dot_quote(F.col("dst")), F.lit(";"))
    return edges.groupBy("root").agg(F.concat(F.lit("digraph deps {\n"), F.array_join(F.array_sort(F.collect_set(arrow)), "\n"), F.lit("\n}")).alias("dot"))
