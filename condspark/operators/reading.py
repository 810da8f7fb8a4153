"""Reading for a token budget, comparing analyses, and bundles of a file with what it includes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, tokens
from . import blocks, build, skeleton, walk


def budgeted(pruned: DataFrame, budget: int) -> DataFrame:
    """(path, target, shown, level, tokens, skeleton_tokens): pruned (path, target, code) as it fits the budget.

    level: full, skeleton, or over where even the skeleton is too long, and then the whole text is shown; 0 sets no
    budget.  Skeletons are made only for texts over the budget; else skeleton_tokens is null.
    """
    cost = tokens.char_estimate(F.col("code"))
    fits = pruned.where((F.lit(budget) <= 0) | (cost <= budget)).select("path", "target", F.col("code").alias("shown"), F.lit("full").alias("level"), F.lit(None).cast("long").alias("skeleton_tokens"))
    long = pruned.where((F.lit(budget) > 0) & (cost > budget)).select("path", "target", "code", skeleton.skeleton("code")["skeleton"].alias("skeleton"))
    long = long.withColumn("skeleton_tokens", tokens.char_estimate(F.col("skeleton")))
    small = F.col("skeleton_tokens") <= budget
    told = fits.unionByName(long.select("path", "target", F.when(small, F.col("skeleton")).otherwise(F.col("code")).alias("shown"), F.when(small, "skeleton").otherwise("over").alias("level"), "skeleton_tokens"))
    return told.withColumn("tokens", tokens.char_estimate(F.col("shown"))).select("path", "target", "shown", "level", "tokens", "skeleton_tokens")


def active_lines(states: DataFrame) -> DataFrame:
    return states.where((F.col("directive").isNull() | F.col("orphan")) & F.col("active")).select("path", "target", "line_no")


def active_diff(one: DataFrame, other: DataFrame, first: int = 20) -> DataFrame:
    """(path, target, only_one, only_other): lines active in one analysis alone, counts and the first of them."""
    both = one.withColumn("a", F.lit(1)).join(other.withColumn("b", F.lit(1)), ["path", "target", "line_no"], "full")
    apart = both.where("a is null or b is null")
    # the first lines by rank, so no file's whole list is gathered
    rank = F.row_number().over(W.partitionBy("path", "target", F.col("a").isNull()).orderBy("line_no"))
    ranked = apart.withColumn("r", rank)
    sample = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNotNull() & (F.col("r") <= first), F.col("line_no"))))
    return ranked.groupBy("path", "target").agg(F.count("a").alias("only_one"), F.count("b").alias("only_other"), sample("a").alias("first_one"), sample("b").alias("first_other"))


#: Fixed value: a line marker of a preprocessor, its line and file.
MARKER = r'^\s*#\s+(\d+)\s+"([^"]+)"'


def _runs(outputs: DataFrame, cwd: str) -> DataFrame:
    """outputs with _lines and _runs: for each marker and what follows it (at, n, own, filled), at being the marker's place.

    The file that a run belongs to is its marker's, however deep the headers are nested; own tells whether it is the path,
    filled whether any line of it holds more than white space.
    """
    rows = outputs.withColumn("_lines", text.split_lines(F.coalesce("code", F.lit(""))))
    file = lambda x: text.resolve(F.regexp_extract(x, MARKER, 2), F.lit(cwd))
    found = F.transform("_lines", lambda x, i: F.when(x.contains("#") & x.rlike(MARKER), F.struct(i.alias("at"), F.regexp_extract(x, MARKER, 1).cast("int").alias("n"), (file(x) == text.resolve(F.col("path"), F.lit(cwd))).alias("own"))))
    rows = rows.withColumn("_marks", F.filter(found, lambda m: m.isNotNull()))
    end = lambda k: F.coalesce(F.get("_marks", k + 1)["at"], F.size("_lines"))
    filled = lambda m, k: F.exists(F.slice("_lines", m["at"] + 2, F.greatest(end(k) - m["at"] - 1, F.lit(0))), lambda x: x.rlike(r"(?U)\S"))
    return rows.withColumn("_runs", F.transform("_marks", lambda m, k: F.struct(m["at"].alias("at"), m["n"].alias("n"), m["own"].alias("own"), (m["own"] & filled(m, k)).alias("filled"))))


def _active() -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter("_runs", lambda r: r["filled"]), lambda r: r["n"])))


def marker_lines(outputs: DataFrame, cwd: str = "/") -> DataFrame:
    """(path, line_no): original lines that preprocessed text (path, code) marks as having code.

    A marker of another file ends the run; the line doesn't advance between markers.  Told within a text's row.
    """
    return _runs(outputs, cwd).select("path", F.explode(_active()).alias("line_no")).distinct()


def _gaps(active: Column, n_lines: Column) -> Column:
    """Runs (lo, hi) of 1 to n_lines that aren't in an ascending array."""
    inside = F.filter(active, lambda x: (x >= 1) & (x <= n_lines))
    # each run lies between two neighbours, the last before the line after the end
    pairs = F.zip_with(F.concat(F.array(F.lit(0)), inside), F.concat(inside, F.array(n_lines + 1)), lambda a, b: F.struct((a + 1).alias("lo"), (b - 1).alias("hi")))
    return F.filter(pairs, lambda r: r["lo"] <= r["hi"])


def missing_ranges(outputs: DataFrame, counts: DataFrame, cwd: str = "/") -> DataFrame:
    """(path, lo, hi): runs of 1..n_lines that outputs (path, code) don't mark; counts: (path, n_lines)."""
    rows = _runs(outputs, cwd).join(counts, "path").select("path", F.explode(_gaps(_active(), F.col("n_lines").cast("int"))).alias("r"))
    return rows.select("path", "r.lo", "r.hi")


#: What stands above preprocessed text after its title, and the widths of its numbers.
ORACLE_NOTES = ["/* Note: Fully preprocessed by clang -E.             */", "/* Macros expanded, #include'd content inlined.       */", "/* Use this output for CROSS-VALIDATION only;         */", "/* prefer the regex backend for normal LLM reading.  */"]
ORACLE_END = "/* --------------------------------------------------- */"


def preprocessed(outputs: DataFrame, title: str, sysroot: str = "", cwd: str = "/") -> DataFrame:
    """(path, target, code, original_lines, pruned_lines, active_lines, skipped) of preprocessed texts, as an oracle beside pruning.

    outputs: (path, target, code, original), original being the source's text.  code is the banner and all lines but the
    markers, headers' lines included, in their order; pruned_lines counts those that aren't blank; active_lines are the
    original's lines that have code, skipped the runs (lo, hi) of its other lines.  Null texts are empty.  All
    from one pass within a row.
    """
    source = F.coalesce("original", F.lit(""))
    rows = _runs(outputs, cwd).withColumn("original_lines", tokens.newline_count(source)).withColumn("_on", _active())
    rows = rows.withColumn("skipped", _gaps(F.col("_on"), F.col("original_lines").cast("int")))
    marks = F.transform("_marks", lambda m: m["at"])
    kept = F.filter("_lines", lambda x, i: ~F.array_contains(marks, i))
    right = lambda n: F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(5) - F.length(n.cast("string")), F.lit(0))), n.cast("string"))
    left = lambda v: F.concat(v, F.repeat(F.lit(" "), F.greatest(F.lit(36) - F.length(v), F.lit(0))))
    backend = left(F.concat(F.lit("sysroot="), F.lit(sysroot))) if sysroot else left(F.lit("auto-detect"))
    top = F.concat_ws(
        "\n", F.lit(f"/* --- {title} --- */"), F.concat(F.lit("/* Target:    "), left(F.col("target")), F.lit("*/")), F.concat(F.lit("/* Backend:   "), backend, F.lit("*/")), *map(F.lit, ORACLE_NOTES),
        F.concat(F.lit("/* Active original lines: "), right(F.size("_on")), F.lit("                */")), F.concat(F.lit("/* Skipped ranges: "), right(F.size("skipped")), F.lit("                       */")), F.lit(ORACLE_END),
    )
    rows = rows.withColumn("_kept", kept)
    return rows.select(
        "path", "target", F.concat(top, F.lit("\n\n"), F.array_join("_kept", "\n")).alias("code"), "original_lines", F.size(F.filter("_kept", lambda x: x.rlike(r"(?U)\S"))).cast("long").alias("pruned_lines"), F.col("_on").alias("active_lines"), "skipped",
    )


def bundle(roots: DataFrame, deps: DataFrame) -> DataFrame:
    """(root, text): the root's code, then its dependencies' skeletons by name.

    roots: (root, code); deps: (root, path, code), code null where a file can't be read.
    """
    said = deps.withColumn("part", F.concat(F.lit("/* --- "), text.basename(F.col("path")), F.lit(" --- */\n"), F.coalesce(skeleton.skeleton("code")["skeleton"], F.lit("/* Skipped */"))))
    said = said.withColumn("part", F.when(F.col("code").isNull(), F.concat(F.lit("/* --- "), text.basename(F.col("path")), F.lit(" --- */\n/* Skipped */"))).otherwise(F.col("part")))
    parts = said.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(text.basename(F.col("path")).alias("name"), "path", "part"))), lambda d: d["part"]), "\n\n").alias("parts"))
    return roots.join(parts, "root", "left").select("root", F.concat_ws("\n\n", "code", "parts").alias("text"))


#: The rule beside a file's name and what a walk says that a condition ended.
ENDED = "/* Error: Unclosed conditional directives: "
RULE = "══════════════════"


def with_dependencies(files: DataFrame, dirs: DataFrame, roots: DataFrame, targets: DataFrame, title: str, max_depth: int = 2, mode: str = "physical") -> DataFrame:
    """(root, target, n_deps, text): each root pruned, then skeletons of the headers that it includes for the target.

    files: (path, code); dirs as for includes.resolve; roots: (root, target); targets: (target, macros), the macros
    that the root's build gives and the target's three.  Headers are those that a depth-first walk over active includes
    opens, ``max_depth`` files deep; they come by name (of headers of one name the one visited last) and are pruned
    with the target's three macros alone, as no build entry names them.  Each file is pruned once a target, however many
    roots reach it.  Where a condition that can't be evaluated ends the walk, the text tells that alone.
    """
    walked = walk.walk(files, dirs, roots, targets, max_depth)
    names = walk.name_graph(walked)
    lost = walked.errors.select("root", "target", "error")
    deps = names.where(F.col("name") != text.basename(F.col("root"))).select("root", "target", "name", "path").join(lost, ["root", "target"], "left_anti")
    wanted = deps.select("path", "target").distinct().join(files, "path").withColumn("macros", build.target_macros(F.col("target")))
    plain = blocks.prune(wanted.select("path", "target", "macros", "code"), mode).select("path", "target", skeleton.skeleton("code").alias("s"))
    # fixed values: the lines above a file, a header and the whole
    head = lambda kind, name: F.concat(F.lit(f"/* ══ {kind}: "), name, F.lit(f" {RULE} */\n"))
    part = F.concat(F.lit("\n"), head("DEPENDENCY", F.col("name")), F.lit("/* Skeleton: "), F.col("s.skeleton_lines").cast("string"), F.lit(" lines | Functions stripped: "), F.col("s.functions_stripped").cast("string"), F.lit(" */\n\n"), F.col("s.skeleton"))
    parts = deps.join(plain, ["path", "target"]).groupBy("root", "target").agg(F.count("*").alias("n_deps"), F.transform(F.array_sort(F.collect_list(F.struct("name", part.alias("part")))), lambda d: d["part"]).alias("parts"))
    begun = walked.visits.where("depth = 0").select("root", "target").join(targets, "target").join(files.withColumnRenamed("path", "root"), "root")
    pruned = blocks.prune(begun.select(F.col("root").alias("path"), "target", "macros", "code"), mode).withColumnRenamed("path", "root")
    rows = pruned.join(parts, ["root", "target"], "left").withColumn("n_deps", F.coalesce("n_deps", F.lit(0)).cast("long"))
    name = text.basename(F.col("root"))
    line = lambda label, value, gap: F.concat(F.lit(f"/* {label}: "), value, F.lit(f"{gap}*/\n"))
    top = F.concat(
        F.lit(f"/* ── {title} ──────────────── */\n"), line("Target", F.col("target"), " " * 32), line("Root", name, " " * 27), line("Dependencies", F.col("n_deps").cast("string"), " files        "),
        F.lit(f"/* Max depth: {max_depth}                          */\n/* Mode: {mode}                                    */\n/* Backend: regex                          */\n/* ─────────────────────────────────────────────── */\n\n"),
    )
    first = F.concat(head("TARGET FILE", name), F.lit("/* Original: "), F.col("original_lines").cast("string"), F.lit(" lines | Pruned: "), F.col("pruned_lines").cast("string"), F.lit(" lines */\n\n"), F.col("code"))
    rows = rows.join(lost, ["root", "target"], "left")
    said = F.when(F.col("error").isNotNull(), F.concat(F.lit(ENDED), "error", F.lit(" */"))).otherwise(F.concat(top, F.concat_ws("\n", first, "parts")))
    return rows.select("root", "target", "n_deps", said.alias("text"))
