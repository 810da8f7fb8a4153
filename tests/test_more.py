"""Sources, macros and streaming on small files."""

import errno
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from condspark.functions import text
from condspark.operators import blocks, build, includes, paths, report
from condspark.sources import files
from condspark.streaming import watch


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.c").write_bytes(b"int a;\xff\n")
    (tmp_path / "src/n.txt").write_text("no")
    got = files.source_files(spark, str(tmp_path / "src")).collect()
    assert len(got) == 1 and got[0].path.endswith("/src/a.c") and got[0].code == "int a;�\n"
    db = [{"directory": "/w", "file": "a.c", "command": "gcc -D'X=a b' -DY a.c"}, {"directory": "/w", "file": "b.c", "arguments": ["cc", "-DZ=1"]}]
    (tmp_path / "compile_commands.json").write_text(json.dumps(db))
    e = build.with_tokens(files.compile_commands(spark, str(tmp_path / "compile_commands.json")))
    assert {r.entry_ord: r.m for r in e.select("entry_ord", build.macros_of(F.col("tokens")).alias("m")).collect()} == {0: {"X": "a b", "Y": None}, 1: {"Z": "1"}}


def test_database_path(spark):
    p = spark.createDataFrame([("a", "/a", ""), ("b", "/b", "x.json"), ("c", "/c", "gone.json")], "project string, root string, configured string")
    listing = spark.createDataFrame([("/a/compile_commands.json",), ("/b/x.json",), ("/c/compile_commands.json",)], "path string")
    assert {r.project: r.path for r in files.database_path(p, listing).collect()} == {"a": "/a/compile_commands.json", "b": "/b/x.json", "c": None}


def test_lines_and_macros(spark):
    d = spark.createDataFrame([("a\r\nb\rc\x0bd\n",), ("",), ("x\n\n",)], "t string")
    assert [r[0] for r in d.select(text.split_lines(F.col("t"))).collect()] == [["a", "b", "c", "d"], [], ["x", ""]]
    m = spark.createDataFrame([({"A": "1", "B": None}, {"B": "2"})], "a map<string,string>, b map<string,string>")
    assert m.select(build.union_macros(F.col("a"), F.col("b"))).first()[0] == {"A": "1", "B": "2"}


def test_watch(spark, tmp_path):
    spark.createDataFrame([("/a.c", "#ifdef ON\nx;\n#endif\ny;")], "path string, code string").write.parquet(str(tmp_path / "in"))
    targets = spark.createDataFrame([("on",), ("off",)], "target string").withColumn("macros", build.target_macros(F.col("target")))
    seen = []
    watch.watch(spark, str(tmp_path / "in"), targets, lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert {r.target: r.code for r in seen} == {"on": "x;\ny;", "off": "y;"}


def test_conditional_closure(spark):
    """Active includes are followed to the end for each target, cycles and the depth bound included; skipped ones are told."""
    code = [("/p/app.c", '#include "utils.h"\n#ifdef PRODUCT_A\n#include <wifi.h>\n#else\n#include "plain.h"\n#endif\n'), ("/p/include/utils.h", '#include "types.h"\n#include <stdio.h>\n'), ("/p/include/wifi.h", "void up(void);\n"), ("/p/include/types.h", '#include "utils.h"\n#ifdef PRODUCT_A\n#include "deep.h"\n#endif\n'), ("/p/include/deep.h", "int x;\n")]
    files = spark.createDataFrame(code, "path string, code string")
    dirs = spark.createDataFrame([(0, "/p/include")], "ord int, dir string")
    targets = spark.createDataFrame([("product_a",), ("other",)], "target string").withColumn("macros", build.target_macros(F.col("target")))
    roots = spark.createDataFrame([(r, t) for r in ("/p/app.c", "/p/none.c") for t in ("product_a", "other")], "root string, target string")
    base = {("other", "/p/app.c", 0), ("other", "/p/include/utils.h", 1), ("other", "/p/include/types.h", 2)}
    more = {("product_a", p, d) for _, p, d in base} | {("product_a", "/p/include/wifi.h", 1)}
    deep = {("product_a", "/p/include/deep.h", 3)}
    for bound, want in ((10, base | more | deep), (3, base | more | deep), (2, base | more), (1, {x for x in base | more if x[2] < 2})):
        reached, met = includes.conditional_closure(files, dirs, roots, targets, bound)
        assert sorted((r.target, r.path, r.depth) for r in reached.collect()) == sorted(want)
        skipped = {(r.target, r.path, r.header) for r in met.where("not active").collect()}
        assert skipped == {("product_a", "/p/app.c", "plain.h"), ("other", "/p/app.c", "wifi.h")} | ({("other", "/p/include/types.h", "deep.h")} if bound > 2 else set())


def test_two_places_as_python_rounds(spark):
    rng = random.Random(1)
    values = [2.675, 0.125, 0.375, 3.125, 0.0, 100.0, 1 / 3, 66.666, 0.005, 0.015] + [rng.randint(0, 4000) / rng.randint(1, 4000) * 100 for _ in range(3000)]
    d = spark.createDataFrame([(v,) for v in values], "v double")
    assert all(r.x == round(r.v, 2) for r in d.select("v", report.two_places(F.col("v")).alias("x")).collect())


def test_savings_without_the_original(spark):
    d = spark.createDataFrame([("a" * 370, "b" * 37, 5), (None, "b" * 37, 5), ("", "", 0), (None, None, 0)], "o string, p string, n int")
    got = [tuple(r.s) for r in d.select(report.savings(F.col("o"), F.col("p"), F.col("n")).alias("s")).collect()]
    assert got[:3] == [(100, 10, 90, 90.0), (10 + 2, 10, 0, 0.0), (0, 0, 0, 0.0)]


def test_match_by_path_alone_and_first_entry(spark):
    files = spark.createDataFrame([("/w/a.c",), ("/x/a.c",), ("/x/b.h",)], "path string")
    entries = spark.createDataFrame([(0, "/w", "../y/a.c"), (1, "/w", "a.c"), (2, "/w", "a.c")], "entry_ord int, directory string, file string")
    by = {r.path: r.entry_ord for r in build.match_files(files, entries).collect()}
    assert by == {"/w/a.c": 0, "/x/a.c": 0, "/x/b.h": None}
    assert {r.path: r.entry_ord for r in build.match_files(files, entries, by_name=False).collect()} == {"/w/a.c": 1, "/x/a.c": None, "/x/b.h": None}
    names = spark.createDataFrame([(x,) for x in ("/a.c", "/a.CPP", "/a.cc", "/a.h", "/c++")], "n string")
    assert [r[0] for r in names.select(build.is_cpp(F.col("n"))).collect()] == [False, True, True, False, False]


def test_deep_closure_has_small_plans(spark):
    edges = spark.createDataFrame([(f"f{i}", f"f{i + 1}") for i in range(30)] + [("f9", "f0")], "src string, dst string")
    got = includes.closure(edges, spark.createDataFrame([("f0",)], "root string"), 10)
    assert {(r.path, r.depth) for r in got.collect()} == {(f"f{i}", i) for i in range(10)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_cached_database_follows_the_file(spark, tmp_path):
    f = tmp_path / "compile_commands.json"
    f.write_text('[{"directory": "/w", "file": "a.c", "command": "cc -DA a.c"}]')
    one = files.cached_commands(spark, str(f))
    assert files.cached_commands(spark, str(f)) is one and one.count() == 1
    f.write_text('[{"directory": "/w", "file": "a.c", "command": "cc"}, {"directory": "/w", "file": "b.c", "command": "cc"}]')
    os.utime(f, (1, 1))
    assert files.cached_commands(spark, str(f)).count() == 2
    for i in range(files.KEPT):
        g = tmp_path / f"{i}.json"
        g.write_text("[]")
        files.cached_commands(spark, str(g))
    assert len(files._parsed) == files.KEPT and str(f) not in files._parsed


def test_written_texts_are_not_replaced_unasked(spark, tmp_path):
    d = spark.createDataFrame([("/a.c", "int a;")], "path string, code string")
    files.write_texts(d, str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        files.write_texts(d, str(tmp_path / "out"))
    files.write_texts(d.limit(0), str(tmp_path / "out"), force=True)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 0


def test_nulls_in_sources(spark):
    d = spark.createDataFrame([("/a.c", "t", {"A": None}, None), ("/b.c", "t", {"A": None}, ""), ("/c.c", "t", {}, "#ifdef A\nx\n")], "path string, target string, macros map<string, string>, code string")
    got = {r.path: (r.code, r.original_lines, r.pruned_lines) for r in blocks.prune(d).collect()}
    assert got == {"/a.c": ("", 0, 0), "/b.c": ("", 0, 0), "/c.c": ("", 2, 0)}
    assert {r.path: r.code for r in blocks.prune(d, "virtual").collect()}["/c.c"] == "/* [IFDEF A - INACTIVE] */\n\n/* [WARN: unclosed directives: ifdef] */"
    assert blocks.line_states(d).where("path <> '/c.c'").count() == 0 and includes.walked_includes(d).count() == 0


def test_real_paths_beside_a_file_system(spark, tmp_path):
    """Links of all kinds, made on disk and told in a table, lead to the same places."""
    rng = random.Random(8)
    folders = [tmp_path / x for x in ("a", "a/b", "a/b/c", "d", "d/e")]
    for f in folders:
        f.mkdir()
    links = []
    for i in range(14):
        place = rng.choice(folders) / f"l{i}"
        to = rng.choice([str(rng.choice(folders)), os.path.relpath(rng.choice(folders), place.parent), f"../{rng.choice(folders).name}", f"l{rng.randint(0, 13)}", f"./l{rng.randint(0, 13)}/..", "gone/x"])
        place.symlink_to(to)
        links.append((str(place), to))
    for name, to in (("x1", "x2"), ("x2", "./x1"), ("grow", "grow/x")):
        (tmp_path / "a" / name).symlink_to(to)
        links.append((str(tmp_path / "a" / name), to))
    names = [f.name for f in folders] + [f"l{i}" for i in range(14)] + ["..", ".", "none"]
    asked = {str(rng.choice(folders)) + "/" + "/".join(rng.choice(names) for _ in range(rng.randint(0, 5))) for _ in range(150)} | {p for p, _ in links}
    got = {r.path: r.real for r in paths.real_paths(spark.createDataFrame([(p,) for p in sorted(asked)], "path string"), spark.createDataFrame(links, "link string, to string")).collect()}
    assert set(got) == asked
    for p in asked:
        try:
            os.path.realpath(p, strict=True)
        except OSError as e:
            if e.errno == errno.ELOOP:
                continue
        if got[p] is not None:
            assert got[p] == os.path.realpath(p), p
    looped = {p for p in asked if got[p] is None}
    assert {p for p, _ in links[-3:]} <= looped
