"""Queries of many cases, each met by every row of a table with the row's own numbers in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import conditions, text
from ..operators import blocks, hunks, includes, patch, paths, reading, skeleton
from ..sources import files as sources
from . import corpora
from .corpora import table
from .registry import query, sql_text

#: (macros, condition, truth in SQL, None being an error); {v} is the part's size, {x} the same in hex, {e} its parity.
CONDITIONS = [
    ("P={v}", "P == 3", "v = 3"), ("P={v}", "P != 5", "v <> 5"), ("{e}", "defined(EVEN) && defined(ODD)", "false"), ("{e},B", "defined(EVEN) && defined(B)", "v % 2 = 0"),
    ("{e}", "defined EVEN || defined(NONE)", "v % 2 = 0"), ("{e}", "!defined(EVEN)", "v % 2 = 1"), ("{e},B", "!defined(EVEN) || defined(B)", "true"), ("P={v}", "P", "v <> 0"),
    ("P={v}", "P > 3 && P < 10", "v > 3 AND v < 10"), ("P={v}", "P >= 5 && P <= 5", "v = 5"), ("P={v}", "(P == 5) || (P == 6)", "v IN (5, 6)"), ("P={v}", "(P == 5) && (P == 6)", "false"),
    ("P=0x{x}", "P == {v}", "true"), ("P={v}", "P == 0x{x}", "true"), ("P={v}", "P + 1 == 6", "v = 5"), ("P={v}", "P * 2 == 10", "v = 5"), ("P={v}", "P % 7 == 3", "v % 7 = 3"),
    ("P={v}", "P / 2 > 10", "v // 2 > 10"), ("P={v}", "P - 30 > 0", "v > 30"), ("P={v}", "P - 60 < 0", "v < 60"), ("{e}", "EVEN == 1", "v % 2 = 0"), ("", "A == {v}", "v = 0"),
    ("{e}", "IS_ENABLED(EVEN) || is_builtin(NONE)", "v % 2 = 0"), ("{e}", "ISC_ENABLED( ODD )", "v % 2 = 1"), ("X={v},Y=3", "X + Y == 8", "v = 5"), ("X=0,Y={v}", "!X && Y", "v <> 0"),
    ("P={v}", "P == {v}.0 && P < {v}.5", "true"), ("P={v}.5", "P > {v}", "true"), ("P={v}", "((P == 4) || ((P > 40)))", "v = 4 OR v > 40"),
]
QUIRKS = [
    ("A={v}", "!A == 1", "v <> 1"), ("A={v}", "(A) == 1", None), ("A={v}", "2*(A+1) == 4", "v = 1"), ("A={v}", "A == -1", None), ("A={v}", "A == !A", None), ("A={v}", "{v}L", None),
    ("A={v}", "A << {v}", None), ("A={v}", "~A", "v <> 0"), ("A={v}", "A == 0{v}", "true"), ("A={v}L", "A == 1", "true"), ("a={v}", "A == {v}", "true"), ("A={v}", "A / 0 == {v}", "true"),
    ("A={v}", "A % 0 == 0", "true"), ("A={v}", "A // note {v}", None), ("A={v}", "A /* {v} */", None), ("a=1,A={v}", "A == {v}", "true"), ("A={v},a=1", "A == {v}", "v = 1"), ("A={v}", "A || \\", None),
    ("A={v}", "", None), ("FOO={v}", "FOO({v},2)", "true"), ("{e}", "EVEN(1, (2)) && defined(EVEN)", "v % 2 = 0"), ("A={v}", '__has_include("x{v}.h")', "false"), ("A={v}", "A == 3 == 1", None), ("A={v}", "A @== 3", "v = 3"),
]


def _filled(value: Column, v: Column) -> Column:
    for mark, by in (("{v}", v.cast("string")), ("{x}", F.lower(F.hex(v))), ("{e}", F.when(v % 2 == 0, "EVEN").otherwise("ODD"))):
        value = F.replace(value, F.lit(mark), by)
    return value


def _conditions(spark: SparkSession, sf_dir: str, cases: list[tuple]) -> DataFrame:
    asked = F.array(*[F.struct(F.lit(i).alias("case_id"), F.lit(m).alias("macros"), F.lit(c).alias("condition")) for i, (m, c, _) in enumerate(cases)])
    keys = corpora.spread(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("v")), "p_partkey")
    d = keys.select("p_partkey", "v", F.inline(asked)).select("p_partkey", "case_id", _filled(F.col("macros"), F.col("v")).alias("macros"), _filled(F.col("condition"), F.col("v")).alias("condition"))
    parts = F.filter(F.split("macros", ","), lambda x: x != "")
    sets = F.map_from_entries(F.transform(parts, lambda x: F.struct(F.substring_index(x, "=", 1), F.when(x.contains("="), F.substring_index(x, "=", -1)))))
    got = conditions.with_results(d.withColumn("macro_key", conditions.macro_key(sets)))
    # an error counts as false, and is told beside
    return got.select("p_partkey", "case_id", F.col("cond_result").alias("result"), F.col("cond_error").isNotNull().alias("failed"))


def _truths(cases: list[tuple]) -> str:
    rows = ", ".join(f"({i}, {c or 'false'}, {sql_text(c is None)})" for i, (*_, c) in enumerate(cases))
    return f"SELECT p_partkey, case_id, result, failed FROM (SELECT p_partkey, p_size AS v FROM part), LATERAL (VALUES {rows}) t(case_id, result, failed)"


@query(_truths(CONDITIONS))
def cond_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conditions(spark, sf_dir, CONDITIONS)


@query(_truths(QUIRKS))
def cond_quirks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conditions(spark, sf_dir, QUIRKS)


# -- includes of walk_tree

TREE = """x AS (SELECT s_suppkey AS s, (SELECT count(*) FROM supplier) AS n FROM supplier),
inc AS (SELECT s, o, CASE o WHEN 4 THEN 'n' || k // 5 || '.h' WHEN 6 THEN 'stdio.h' ELSE '../d' || k % 5 || '/n' || k // 5 || '.h' END AS header,
 CASE o WHEN 6 THEN NULL WHEN 4 THEN CASE WHEN k // 5 * 5 + s % 5 < n THEN k // 5 * 5 + s % 5 ELSE k // 5 * 5 END ELSE k END AS f
 FROM x, LATERAL (VALUES (2, (s * 7 + 3) % n), (4, (s * 5 + 1) % n), (6, 0), (7, CASE WHEN s % 11 <> 5 THEN (s * 3 + 2) % n END), (8, CASE WHEN s % 3 = 0 THEN (s * s + 1) % n END)) v(o, k) WHERE k IS NOT NULL)"""
PLACE = "'/t/d' || {0} % 5 || '/n' || {0} // 5 || '.h'"


@query(f"WITH {TREE} SELECT {PLACE.format('s')} AS path, o AS line_no, header, CASE WHEN f IS NOT NULL THEN {PLACE.format('f')} END AS dst FROM inc")
def include_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, dirs, _ = corpora.walk_tree(spark, sf_dir)
    return includes.resolve(includes.include_lines(files), files, dirs)


@query(f"WITH {TREE} SELECT {PLACE.format('s')} AS path, target, o AS line_no, header, CASE o WHEN 2 THEN target = 'product_a' WHEN 4 THEN target = 'other' WHEN 8 THEN s % 11 <> 5 ELSE true END AS active FROM inc, (VALUES ('product_a'), ('other')) t(target)")
def include_closure_cond(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct includes as pruning tells branches, where a bad condition is false; include_depth_first goes on from them."""
    files, _, targets = corpora.walk_tree(spark, sf_dir)
    return includes.active_includes(files.crossJoin(F.broadcast(targets)))  # two targets


HEADER = """'#ifdef PRODUCT_A' || chr(10) || '#include "h' || ({0} * 7 + 3) % n || '.h"' || chr(10) || '#else' || chr(10) || '#include "h' || ({0} * 5 + 1) % n || '.h"' || chr(10) || '#endif' || chr(10) || '#include <stdio.h>' || chr(10)
 || CASE WHEN {0} % 3 = 0 THEN '#include "h' || ({0} * 3 + 2) % n || '.h"' || chr(10) ELSE '' END || 'int f' || {0} || '(int a,' || CASE {1} WHEN 0 THEN chr(10) || '    int b)' || chr(10) || '{{' || chr(10) || '    return a + b;' || chr(10) || '}}' || chr(10) ELSE ' int b)' || chr(10) || '{{ /* ... */ }}' END"""


@query(f"""WITH x AS (SELECT s_suppkey AS s, (SELECT count(*) FROM supplier) AS n FROM supplier),
deps AS (SELECT s, n, d, lost FROM x, LATERAL (VALUES ((s * 7 + 3) % n, s % 4 = 0), ((s * 5 + 1) % n, false)) v(d, lost)),
parts AS (SELECT s, string_agg('/* --- h' || d || '.h --- */' || chr(10) || CASE WHEN lost THEN '/* Skipped */' ELSE {HEADER.format('d', 1)} END, chr(10) || chr(10) ORDER BY 'h' || d || '.h') AS parts FROM (SELECT s, n, d, bool_and(lost) AS lost FROM deps GROUP BY s, n, d) GROUP BY s)
SELECT '/h/h' || s || '.h' AS root, md5({HEADER.format('s', 0)} || chr(10) || chr(10) || parts) AS text_md5 FROM x JOIN parts USING (s)""")
def bundle_with_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every header with two that it includes; some of those can't be read."""
    files, _, _ = corpora.header_tree(spark, sf_dir)
    s, n = F.regexp_extract("path", r"(\d+)\.h$", 1).cast("long"), F.lit(table(spark, sf_dir, "supplier").count())
    name = lambda k: F.concat(F.lit("/h/h"), k.cast("string"), F.lit(".h"))
    met = files.select(F.col("path").alias("root"), F.explode(F.array(F.struct(name((s * 7 + 3) % n).alias("path"), (s % 4 == 0).alias("lost")), F.struct(name((s * 5 + 1) % n).alias("path"), F.lit(False).alias("lost")))).alias("d"))
    met = met.groupBy("root", F.col("d.path").alias("path")).agg(F.min("d.lost").alias("lost"))
    deps = met.join(files, "path").select("root", "path", F.when(~F.col("lost"), F.col("code")).alias("code"))
    return reading.bundle(files.select(F.col("path").alias("root"), "code"), deps).select("root", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# -- paths and settings

#: (path, verdict in SQL, real path); {s} is the supplier.  /ok leads to /real for even ones, link to /real by two links.
SAFETY = [
    ("/p/{s}/src/a.c", "'ok'", "/p/{s}/src/a.c"), ("/p/{s}/link/a.c", "CASE WHEN s % 2 = 0 THEN 'ok' ELSE 'outside' END", "/real/{s}/a.c"), ("/p/{s}/link/../x.c", "'outside'", "/real/x.c"), ("/p/{s}/loop/a.c", "'loop'", None),
    ("/p/{s}/.git/x", "'denied'", "/p/{s}/.git/x"), ("/p/{s}s/a.c", "'outside'", "/p/{s}s/a.c"), ("/p/{s}/src/../../etc/./a", "'outside'", "/p/etc/a"), ("p/{s}//b.c", "'ok'", "/p/{s}/b.c"), ("/p/{s}/back/c.c", "'denied'", "/p/{s}/.git/c.c"), ("/p/{s}", "'ok'", "/p/{s}"),
]


@query("SELECT s_suppkey AS s, case_id, CASE case_id " + " ".join(f"WHEN {i} THEN {'NULL' if r is None else sql_text(r).replace('{s}', chr(39) + ' || s_suppkey || ' + chr(39))}" for i, (*_, r) in enumerate(SAFETY)) + " END AS real, CASE case_id " + " ".join(f"WHEN {i} THEN {v.replace('s %', 's_suppkey %')}" for i, (_, v, _) in enumerate(SAFETY)) + f" END AS verdict FROM supplier, range(0, {len(SAFETY)}) t(case_id)")
def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real paths and their safety for each supplier's folder, with chains of links, loops, and links in the allowed folders."""
    s = F.col("s").cast("string")
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"))
    at = lambda x: F.replace(F.lit(x), F.lit("{s}"), s)
    linked = [("/p/{s}/link", "../q/{s}"), ("/p/q/{s}", "/real/{s}"), ("/p/{s}/loop", "loop2"), ("/p/{s}/loop2", "./loop"), ("/p/{s}/back", ".git")]
    links = keys.select(F.inline(F.array(*[F.struct(at(a).alias("link"), at(b).alias("to")) for a, b in linked]))).unionByName(keys.where("s % 2 = 0").select(at("/ok/{s}").alias("link"), at("/real/{s}").alias("to")))
    asked = keys.select("s", F.posexplode(F.array(*[at(p) for p, *_ in SAFETY])).alias("case_id", "path"), F.array(at("/p/{s}"), at("/ok/{s}")).alias("allow"), F.array(at("/p/{s}/.git")).alias("deny"))
    return paths.verdicts(asked, links).select("s", "case_id", "real", "verdict")


@query("""SELECT s_suppkey AS project, key, kind, value FROM supplier, LATERAL (VALUES ('pruner.token_budget', 'int', s_suppkey::VARCHAR), ('pruner.default_target', 'string', 't' || s_suppkey), ('pruner.strict', 'bool', CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END), ('pruner.dirs', 'list', '[a' || s_suppkey || ', b]'),
 ('pruner.ratio', 'float', s_suppkey || '.25'), ('pruner.bad', 'string', '1.' || s_suppkey || '.3'), ('pruner.big', 'int', '1_000'), ('other.strict', 'bool', 'false')) v(key, kind, value)""")
def config_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of each supplier: sections, comments, later values over earlier ones, and the kinds of values."""
    s = F.col("s_suppkey").cast("string")
    lines = ["token_budget = {s} # cap", "[pruner]", 'default_target = "t{s}"', "strict = {y}", "dirs = [a{s}, b]", "ratio = {s}.5", "bad = 1.{s}.3", "[other]", "strict = off", "", "# [none]", "[ pruner ]", "ratio = {s}.25", "big = 1_000", "no value"]
    said = F.replace(F.replace(F.lit("\n".join(lines)), F.lit("{s}"), s), F.lit("{y}"), F.when(F.col("s_suppkey") % 2 == 0, "Yes").otherwise("OFF"))
    got = sources.settings(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("project"), said.alias("text")))
    return got.select("project", "key", sources.coerced(F.col("value")).alias("c")).select("project", "key", "c.kind", "c.value")


# -- skeletons, diffs and syntax

#: (code, skeleton, functions stripped); {k} is the part, {v} its size.
SKELETONS = [
    ("int add{k}(int a, int b) {\n    return a + {v};\n}", "int add{k}(int a, int b)\n{ /* ... */ }", 1),
    ('struct P{k} {\n    int x[{v}];\n};\n\nvoid draw{k}(struct P{k} p) {\n    printf("}{v}");\n}', "struct P{k} {\n    int x[{v}];\n};\n\nvoid draw{k}(struct P{k} p)\n{ /* ... */ }", 1),
    ("#include <a{k}.h>\n\nstatic int\nf{k}(int a,\n  int b)\n{\n    if (a) {\n        b += {v};\n    }\n    return b;\n}\nint g{k};", "#include <a{k}.h>\n\nstatic int f{k}(int a, int b)\n{ /* ... */ }\nint g{k};", 1),
    ("int one{k}(void) { return {v}; }", "int one{k}(void) { return {v}; }\n{ /* ... */ }", 1),
    ("extern int x{k};\nint f(void) {\n    return {v};\n}", "extern int x{k};\nint f(void) {\n    return {v};\n}", 0),
    ("enum E{k} {\n    A = {v}, /* } */\n    B\n};\n/* { */\nlong h{k}(char c)\n{\n    // }\n    return c == '{' ? {v} : '\\'';\n}", "enum E{k} {\n    A = {v}, /* } */\n    B\n};\n/* { */\nlong h{k}(char c)\n{ /* ... */ }", 1),
]


def _by_part(spark: SparkSession, sf_dir: str, texts: list[str]) -> DataFrame:
    k, v = F.col("p_partkey"), F.col("p_size").cast("string")
    chosen = F.get(F.array(*map(F.lit, texts)), (k % len(texts)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.replace(F.replace(chosen, F.lit("{k}"), k.cast("string")), F.lit("{v}"), v).alias("code"))


@query("SELECT p_partkey, replace(replace(CASE p_partkey % " + str(len(SKELETONS)) + " " + " ".join(f"WHEN {i} THEN {sql_text(s)}" for i, (_, s, _) in enumerate(SKELETONS)) + " END, '{k}', p_partkey::VARCHAR), '{v}', p_size::VARCHAR) AS skeleton, CASE p_partkey % " + str(len(SKELETONS)) + " " + " ".join(f"WHEN {i} THEN {n}" for i, (*_, n) in enumerate(SKELETONS)) + " END::BIGINT AS stripped FROM part")
def skeleton_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _by_part(spark, sf_dir, [c for c, *_ in SKELETONS])
    return d.select("p_partkey", skeleton.skeleton("code").alias("s")).select("p_partkey", "s.skeleton", F.col("s.functions_stripped").alias("stripped"))


PATCHED = """WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents), l AS (SELECT doc_id, text, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM d), n AS (SELECT doc_id, text, a, len(a) AS n, 1 + doc_id % greatest(len(a), 1) AS k FROM l),
p AS (SELECT doc_id, text, n > 0 AND doc_id % 5 < 3 AS fine, CASE doc_id % 5 WHEN 0 THEN list_concat(a[:k - 1], ['new ' || doc_id], a[k + 1:]) WHEN 1 THEN list_concat(a[:1], ['ins ' || doc_id], a[2:n - 1], CASE WHEN n > 1 THEN ['last'] ELSE [] END) WHEN 2 THEN list_concat(a[:k - 1], a[k + 1:]) END AS b FROM n)
SELECT doc_id, CASE WHEN fine THEN md5(array_to_string(b, chr(10)) || CASE WHEN ends_with(text, chr(10)) THEN chr(10) ELSE '' END) END AS patched_md5, NOT fine AS failed FROM p"""


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, diff): a diff for each document, made of its lines: one line replaced, hunks that move later ones, a line dropped, wrong context, a hunk past the end."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", text.split_lines(F.col("text")).alias("a"))
    d = d.withColumn("n", F.size("a").cast("long")).withColumn("at", 1 + F.col("doc_id") % F.greatest(F.col("n"), F.lit(1)))
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    k, n, at, line = F.col("doc_id"), F.col("n"), F.col("at"), F.coalesce(F.get("a", (F.col("at") - 1).cast("int")), F.lit(""))
    first, last = F.coalesce(F.get("a", F.lit(0)), F.lit("")), F.coalesce(F.get("a", (F.col("n") - 1).cast("int")), F.lit(""))
    moved = F.when(n > 1, c("@@ -", n, ",1 +", n + 1, ",1 @@\n-", last, "\n+last\n")).otherwise("")
    diff = (
        F.when(k % 5 == 0, c("--- a\n+++ b\n@@ -", at, ",1 +", at, ",1 @@\n-", line, "\n+new ", k, "\n")).when(k % 5 == 1, c("@@ -1,1 +1,2 @@\n ", first, "\n+ins ", k, "\n", moved))
        .when(k % 5 == 2, c("@@ -", at, ",1 +", at, ",0 @@\n-", line, "\n")).when(k % 5 == 3, c("@@ -", at, ",1 +", at, ",1 @@\n-", line, " not\n+x\n")).otherwise(c("@@ -", n + 2, ",1 +", n + 2, ",1 @@\n-x\n+y\n"))
    )
    return d.select("doc_id", "text", diff.alias("diff"))


@query(PATCHED)
def patch_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs applied text by text."""
    return _diffs(spark, sf_dir).select("doc_id", patch.patched("text", "diff").alias("p")).select("doc_id", F.md5(F.col("p.patched").cast("binary")).alias("patched_md5"), F.col("p.error").isNotNull().alias("failed"))


@query(PATCHED)
def patch_by_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same diffs as rows of hunks, checked and put in place by joins."""
    d = _diffs(spark, sf_dir)
    got = hunks.apply_diffs(d.select(F.col("doc_id").alias("path"), F.col("text").alias("code")), d.select(F.col("doc_id").alias("path"), "diff"))
    return got.select(F.col("path").alias("doc_id"), F.md5(F.col("patched").cast("binary")).alias("patched_md5"), F.col("error").isNotNull().alias("failed"))


@query("""WITH x AS (SELECT p_partkey, p_partkey % 3 AS braces, p_size % 4 AS ifs, p_size % 5 = 0 AS stray FROM part)
SELECT p_partkey, concat_ws('; ', CASE WHEN stray THEN 'line 1: #endif without matching #if; line 2: #else without matching #if' END, CASE WHEN braces > 0 THEN 'unbalanced braces: depth=' || braces || ' at end of file' END, CASE WHEN ifs > 0 THEN 'unbalanced #if/#endif: ' || ifs || ' unmatched #if at end of file' END) AS warnings FROM x""")
def syntax_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open braces and blocks by the part's numbers, among strings, characters and comments over several lines that hide others."""
    k, v = F.col("p_partkey"), F.col("p_size")
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    hidden = ['char *s = "{ \\" {";\n', "char q = '{', r = '\\'';\n", "/* {\n { // \n #if no\n*/ int a;\n"]
    # a directive's line counts within a comment too, so that one is closed
    code = c(F.when(v % 5 == 0, "#endif\n#else\n").otherwise(""), *hidden, "#endif\n", F.repeat(F.lit("#if A\n#else\n"), (v % 4).cast("int")), F.repeat(F.lit("int f() {\n"), (k % 3).cast("int")), "int g() { return 1; }\n", "// { {\n}\n{\n")
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code")).select("p_partkey", F.array_join(patch.syntax("code"), "; ").alias("warnings"))


FAILURES = [("FileNotFoundError", "[FATAL] {m}\n  hint: check that the file exists and the path is correct"), ("ValueError", "[FATAL] {m}\n  hint: this usually means invalid arguments"), ("PermissionError", "[FATAL] {m}\n  hint: the file is not writable; check permissions"), ("KeyError", "[ERROR] KeyError: {m}")]


@query("SELECT p_partkey, replace(CASE p_partkey % 4 " + " ".join(f"WHEN {i} THEN {sql_text(s)}" for i, (_, s) in enumerate(FAILURES)) + " END, '{m}', p_name) AS said FROM part")
def error_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*[F.lit(k) for k, _ in FAILURES]), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.failure(kind, F.col("p_name")).alias("said"))


@query("""WITH x AS (SELECT p_partkey AS k, p_size AS v FROM part), c AS (SELECT k, v, v > 25 AS big, v % 2 = 0 AS even FROM x)
SELECT '/b/' || k || '.c' AS path, array_to_string(list_filter(['top;', CASE WHEN big AND even THEN 'one;' END, CASE WHEN big AND NOT even THEN 'two;' END, CASE WHEN NOT big THEN 'three;' END, 'bad;', CASE WHEN even THEN 'four;' END], lambda l: l IS NOT NULL), chr(10)) AS code FROM c""")
def prune_bad_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions that can't be evaluated are false when pruning, so their #ifndef is true."""
    v = F.col("p_size")
    lines = ["top;", "#if V > 25", "#if EVEN", "one;", "#elif 1L", "never;", "#else", "two;", "#endif", "#else", "three;", "#endif", "#ifndef A B", "bad;", "#endif", "#ifdef A // no", "never;", "#endif", "#if defined(EVEN)", "four;", "#endif"]
    macros = F.map_filter(F.create_map(F.lit("V"), v.cast("string"), F.lit("EVEN"), F.lit(None).cast("string")), lambda k, _: (k == "V") | (v % 2 == 0))
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("/b/"), F.col("p_partkey").cast("string"), F.lit(".c")).alias("path"), F.lit("t").alias("target"), macros.alias("macros"), F.lit("\n".join(lines)).alias("code"))
    return blocks.prune(files).select("path", "code")
