"""Inputs derived from the tables, which hold no source code; all of them are synthetic.

Every corpus is stated twice, for Spark and for DuckDB, by the same arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import build

LANGS = ["EN", "DE", "FR", "ES"]

#: Line templates of the synthetic sources; numbers from 7 on are code.
TEMPLATES = ["#ifdef HAS_WIFI", "#if PRODUCT_TYPE == 3", "#ifndef CONFIG_X", "#elif PRODUCT_TYPE == 5", "#else", "#endif", "  # endif"]
LINES = 40
#: The templates' numbers by file f and line n, and the truth of their conditions by the part's size.
TEMPLATE_OF = "((f * 31 + n * 17 + (f * n) % 7 + (n * n) % 13) % 11)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt out by key, before each of them becomes many lines or conditions.

    A table of keys is small and comes in few partitions, however much is made of its rows; only the keys move.
    """
    spark = rows.sparkSession
    return rows.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def guarded_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """((path, code), (target, macros)): each document's lines within conditionals, and each language as target."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.upper("lang").alias("lang"))
    code = F.expr("""array_join(transform(split(text, '\\n'), (x, i) -> case i % 4
        when 0 then concat('#ifdef LANG_', lang, '\\n', x, '\\n#else\\nother line\\n#endif')
        when 1 then concat('#if LANG_EN || defined(LANG_FR)\\n', x, '\\n#endif')
        else x end), '\\n')""")
    targets = spark.createDataFrame([(f"lang_{x.lower()}",) for x in LANGS], "target string").withColumn("macros", build.target_macros(F.col("target")))
    return docs.select(F.concat(F.lit("/d/"), F.col("doc_id").cast("string"), F.lit(".c")).alias("path"), code.alias("code")), targets


def guarded_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, target, macros, code): the same, a row for each file and target."""
    files, targets = guarded_files(spark, sf_dir)
    return files.crossJoin(F.broadcast(targets)).select("path", "target", "macros", "code")  # four targets


def synth_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, target, macros, code): a file of LINES lines for each part, with stray and unclosed directives."""
    part = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("f"), "p_size"), "f")
    texts = F.array(*[F.lit(t) for t in TEMPLATES])
    pick = f"transform(sequence(1, {LINES}), n -> cast({TEMPLATE_OF} as int))"
    code = F.transform(F.expr(pick), lambda k, i: F.when(k < len(TEMPLATES), F.get(texts, k)).otherwise(F.concat(F.lit("code_"), (i + 1).cast("string"), F.lit(";"))))
    macros = F.map_filter(
        F.create_map(F.lit("PRODUCT_TYPE"), (F.col("p_size") % 7).cast("string"), F.lit("HAS_WIFI"), F.lit(None).cast("string"), F.lit("CONFIG_X"), F.lit(None).cast("string")),
        lambda k, _: (k == "PRODUCT_TYPE") | ((k == "HAS_WIFI") & (F.col("p_size") % 2 == 0)) | ((k == "CONFIG_X") & (F.col("p_size") % 3 == 0)),
    )
    return part.select(F.concat(F.lit("/s/"), F.col("f").cast("string"), F.lit(".c")).alias("path"), F.lit("t").alias("target"), macros.alias("macros"), F.array_join(code, "\n").alias("code"))


def synth_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(db_id, entry_ord, directory, file, command, arguments): an entry for each part."""
    part = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), "p_size"), "p")
    return part.select(
        F.concat(F.lit("db"), (F.col("p") % 5).cast("string")).alias("db_id"), F.col("p").alias("entry_ord"), F.lit("/w/build").alias("directory"),
        F.concat(F.lit("../src/f"), (F.col("p") % 97).cast("string"), F.when(F.col("p") % 3 == 0, ".cpp").when(F.col("p") % 3 == 1, ".c").otherwise(".S")).alias("file"),
        F.concat(F.lit("gcc -O2 -Wall -Wl,-z -fPIC -DPRODUCT_TYPE="), (F.col("p_size") % 7).cast("string"), F.when(F.col("p") % 2 == 0, " -DHAS_WIFI").otherwise(""), F.lit(" -I inc -Iinc"), (F.col("p") % 4).cast("string"), F.lit(" -x c -DPRODUCT_TYPE="), (F.col("p_size") % 5).cast("string"), F.lit(" -c a.c")).alias("command"),
        F.lit(None).cast("array<string>").alias("arguments"),
    )


def synth_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): two includes for each supplier, with cycles."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    n = s.agg(F.count("*").alias("n"))
    both = s.join(F.broadcast(n))  # one row
    name = lambda c: F.concat(F.lit("h"), c.cast("string"))
    return both.select(name(F.col("s_suppkey")).alias("src"), F.explode(F.array((F.col("s_suppkey") * 7 + 3) % F.col("n"), (F.col("s_suppkey") * 5 + 1) % F.col("n"))).alias("d")).select("src", name(F.col("d")).alias("dst"))


def marked_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, code): preprocessed text with line markers, a small one for each document's id."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("/m/"), F.col("doc_id").cast("string"), F.lit(".c")).alias("path"), F.col("doc_id").alias("d"))
    return docs.select("path", F.concat(F.lit('# 1 "'), "path", F.lit('"\nint a;\n# 1 "/usr/x.h" 1\nint x;\n# '), (F.col("d") % 5 + 2).cast("string"), F.lit(' "'), "path", F.lit('" 2\n'), F.when(F.col("d") % 2 == 0, "int b;").otherwise("   "), F.lit('\n# 9 "'), "path", F.lit('"\nint c;')).alias("code"))


def nested_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, target, code, original): each document's lines as preprocessed text, every third line within a header that includes another."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("/n/"), F.col("doc_id").cast("string"), F.lit(".c")).alias("path"), F.lit("ws63").alias("target"), F.col("text").alias("original"))
    mark = lambda n, file, flag: F.concat(F.lit("# "), n.cast("string") if not isinstance(n, str) else F.lit(n), F.lit(' "'), file, F.lit(f'"{flag}\n'))
    own = F.col("path")
    inner = lambda n: F.concat(mark("1", F.lit("/usr/h.h"), " 1"), F.lit("struct h"), n.cast("string"), F.lit(";\n\n"), mark("3", F.lit("/usr/../usr/sys/deep.h"), " 1 3"), F.lit("  int deep;\n"), mark("9", F.lit("/usr/h.h"), " 2"), F.lit("back in h;"))
    line = lambda x, n: F.when(n % 3 == 1, F.concat(mark(n, own, ""), x)).when(n % 3 == 2, inner(n)).when(n % 6 == 0, F.concat(F.lit("  "), mark(n, F.concat(F.lit("/n/./"), F.substring_index(own, "/", -1)), " 2"), x, F.lit('\n#line 7 "x"'))).otherwise(F.concat(mark(n, own, " 2"), F.lit("   ")))
    code = F.array_join(F.transform(text.split_lines(F.col("original")), lambda x, i: line(x, i + 1)), "\n")
    return docs.select("path", "target", code.alias("code"), "original")


def synth_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """synth_sources with an include in place of each line of code."""
    return synth_sources(spark, sf_dir).withColumn("code", F.regexp_replace("code", r"(?m)^code_(\d+);$", '#include "i$1.h"'))


def header_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, folders, targets): a header for each supplier that includes others, by target, and defines a function."""
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s"))
    header = lambda a, b: F.concat(F.lit('#include "h'), ((F.col("s") * a + b) % F.col("n")).cast("string"), F.lit('.h"\n'))
    body = F.concat(F.lit("int f"), F.col("s").cast("string"), F.lit("(int a,\n    int b)\n{\n    return a + b;\n}\n"))
    code = F.concat(F.lit("#ifdef PRODUCT_A\n"), header(7, 3), F.lit("#else\n"), header(5, 1), F.lit("#endif\n#include <stdio.h>\n"), F.when(F.col("s") % 3 == 0, header(3, 2)).otherwise(F.lit("")), body)
    files = keys.crossJoin(F.broadcast(keys.agg(F.count("*").alias("n")))).select(F.concat(F.lit("/h/h"), F.col("s").cast("string"), F.lit(".h")).alias("path"), code.alias("code"))  # one row
    targets = spark.createDataFrame([("product_a",), ("other",)], "target string").withColumn("macros", build.target_macros(F.col("target")))
    return files, spark.createDataFrame([(0, "/h/include")], "ord int, dir string"), targets


def walk_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, folders, targets): a header for each supplier, five folders repeating the names; some conditions can't be evaluated."""
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s"))
    far = lambda k: F.concat(F.lit('#include "../d'), (k % 5).cast("string"), F.lit("/n"), F.floor(k / 5).cast("string"), F.lit('.h"\n'))
    near = lambda k: F.concat(F.lit('#include "n'), F.floor(k / 5).cast("string"), F.lit('.h"\n'))
    s, n = F.col("s"), F.col("n")
    third = F.when(s % 11 == 5, F.lit("#if 1L\n")).otherwise(far((s * 3 + 2) % n))
    code = F.concat(F.lit("#ifdef PRODUCT_A\n"), far((s * 7 + 3) % n), F.lit("#else\n"), near((s * 5 + 1) % n), F.lit("#endif\n#include <stdio.h>\n"), third, F.when(s % 3 == 0, far((s * s + 1) % n)).otherwise(F.lit("")))
    path = F.concat(F.lit("/t/d"), (s % 5).cast("string"), F.lit("/n"), F.floor(s / 5).cast("string"), F.lit(".h"))
    files = keys.crossJoin(F.broadcast(keys.agg(F.count("*").alias("n")))).select(path.alias("path"), code.alias("code"))  # one row
    targets = spark.createDataFrame([("product_a",), ("other",)], "target string").withColumn("macros", build.target_macros(F.col("target")))
    return files, spark.createDataFrame([(0, "/t/d0")], "ord int, dir string"), targets


def project_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(projects, listing, manifests): a project for each supplier, the files that exist, and the manifests' text."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s"), F.concat(F.lit("/w/s"), F.col("s_suppkey").cast("string")).alias("w"))
    name = lambda *parts: F.concat(*[F.lit(p) if p.startswith("/") or "." in p else F.col(p).cast("string") for p in parts])
    projects = s.select(F.col("s").alias("project"), name("w", "/code/app").alias("root"))
    when = lambda on, *parts: F.when(on, name(*parts))
    k = F.col("s")
    paths = F.array(
        when(k % 4 != 3, "w", "/MANIFEST.md"), name("w", "/out/b.json"), when(k % 5 == 0, "w", "/code/app/build/compile_commands.json"), when(k % 3 == 0, "w", "/code/app/x/y/compile_commands_z.json"),
        name("w", "/code/app/node_modules/compile_commands.json"), when(k % 7 == 0, "w", "/ai/projects/b", "s", "/.toolrc"),
    )
    listing = s.select(F.explode(F.array_compact(paths)).alias("path"))
    wanted = F.when(k % 4 == 0, "beta").when(k % 4 == 1, "none").otherwise("gamma")
    said = F.concat(
        F.lit("repo_root: "), "w", F.lit("\nactive_project: "), wanted, F.lit("\n# note: this\n\n## Project Matrix\n### alpha\n- project_id: a"), k.cast("string"), F.lit("\n- active: "), F.when(k % 2 == 1, "Yes").otherwise("no"),
        F.lit("\n- compile_commands: a.json\n### beta  \n- project_id: old\n- project_id: b"), k.cast("string"), F.lit("\n- compile_commands: out/b.json\n## End\n- stray: x\n"),
    )
    return projects, listing, s.where("s % 4 <> 3").select(name("w", "/MANIFEST.md").alias("manifest"), said.alias("text"))
