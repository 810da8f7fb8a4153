"""Files written to their own places, by jobs that fail or meet files."""

import os
import stat

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from condspark.sources import projects, sinks


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f)).read() for d, _, names in os.walk(root) for f in names}


def test_files_are_created_or_refused(spark, tmp_path):
    (tmp_path / "old.c").write_text("old")
    rows = [(f"{tmp_path}/old.c", "new"), (f"{tmp_path}/a/b/x.c", "é\r\nx"), (f"{tmp_path}/none.c", None), (f"{tmp_path}/two.c", "1"), (f"{tmp_path}/two.c", "2"), (f"{tmp_path}/empty.c", "")]
    texts = spark.createDataFrame(rows, "path string, text string").repartition(4)
    got = {os.path.basename(r.path): (r.written, r.reason) for r in sinks.write_files(texts).collect()}
    assert got == {"old.c": (False, "exists"), "x.c": (True, None), "none.c": (False, "no text"), "two.c": (False, "several texts"), "empty.c": (True, None)}
    assert (tmp_path / "a/b/x.c").read_bytes() == "é\r\nx".encode()
    assert tree(tmp_path).keys() == {"old.c", "a/b/x.c", "empty.c"} and (tmp_path / "old.c").read_text() == "old"
    assert sinks.write_files(texts.where("text = 'new'"), force=True).first().written and (tmp_path / "old.c").read_text() == "new"
    assert sinks.write_files(texts.limit(0)).count() == 0


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    (tmp_path / "a.c").write_text("before")
    bad = F.when(F.col("id") == 37, F.raise_error(F.lit("broken"))).otherwise(F.concat(F.lit("text "), F.col("id").cast("string")))
    texts = spark.range(40).select(F.concat(F.lit(f"{tmp_path}/"), F.when(F.col("id") == 3, "a").otherwise(F.col("id").cast("string")), F.lit(".c")).alias("path"), bad.alias("text"))
    with pytest.raises(PySparkException, match="broken"):
        sinks.write_files(texts, force=True)
    assert tree(tmp_path) == {"a.c": "before"}
    (tmp_path / "9.c").mkdir()  # a place that no file can take, met when moving
    with pytest.raises(PySparkException):
        sinks.write_files(texts.where("id <> 37"), force=True)
    assert not [f for f in tree(tmp_path) if "tmp-" in f]
    (tmp_path / "9.c").rmdir()
    assert all(r.written for r in sinks.write_files(texts.where("id <> 37"), force=True).collect())
    assert tree(tmp_path) == {("a" if i == 3 else str(i)) + ".c": f"text {i}" for i in range(40) if i != 37}


def test_settings_of_projects(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1/.rc").write_text("mine")
    decided = spark.createDataFrame([(i, f"{tmp_path}/p{i}/.rc") for i in range(4)], "project int, settings_path string")
    entries = decided.select("project", F.lit(0).alias("ord"), F.lit("pruner").alias("section"), F.lit("default_target").alias("key"), projects.quoted_value(F.concat(F.lit("t "), F.col("project").cast("string"))).alias("value"), F.lit("Target.").alias("comment"))
    texts = projects.settings_text(entries, "# settings")
    got = {r.project: (r.written, r.refused) for r in sinks.write_settings(decided, texts).collect()}
    assert got == {i: (True, None) if i != 1 else (False, f"{tmp_path}/p1/.rc already exists; pass force=True to overwrite") for i in range(4)}
    assert (tmp_path / "p1/.rc").read_text() == "mine" and 'default_target = "t 2"' in (tmp_path / "p2/.rc").read_text()
    assert all(r.written for r in sinks.write_settings(decided, texts, force=True).collect()) and (tmp_path / "p1/.rc").read_text() != "mine"


def test_patches_where_files_lie(spark, tmp_path):
    for name in ("a.c", "b.c", "c.c"):
        (tmp_path / name).write_text("int x;\nint y;\n")
    os.symlink("/etc", tmp_path / "out")
    (tmp_path / ".git").mkdir()
    files = spark.createDataFrame([(f"{tmp_path}/{n}", "int x;\nint y;\n") for n in ("a.c", "b.c", "c.c", ".git/h", "out/passwd")], "path string, code string")
    fits, unfit = "@@ -1,1 +1,2 @@\n-int x;\n+int z;\n+int f() {\n", "@@ -1,1 +1,1 @@\n-int q;\n+int z;\n"
    diffs = spark.createDataFrame([(f"{tmp_path}/{n}", d) for n, d in (("a.c", fits), ("b.c", unfit), (".git/h", fits), ("out/passwd", fits), ("gone.c", fits))], "path string, diff string")
    links = spark.createDataFrame([(f"{tmp_path}/out", "/etc")], "link string, to string")
    told = {os.path.relpath(r.path, tmp_path): (r.written, r.said) for r in sinks.apply_patches(files, diffs, links, [str(tmp_path)], [f"{tmp_path}/.git"]).collect()}
    assert told["a.c"] == (True, "[OK] Patch applied to a.c via builtin.\n[WARN] Syntax check found 1 issue(s):\n  - unbalanced braces: depth=1 at end of file")
    assert told["b.c"] == (False, "[FATAL] hunk mismatch at line 1") and "denied" in told[".git/h"][1] and "allowed" in told["out/passwd"][1] and "Cannot resolve" in told["gone.c"][1]
    assert (tmp_path / "a.c").read_text() == "int z;\nint f() {\nint y;\n" and (tmp_path / "b.c").read_text() == "int x;\nint y;\n"
    assert stat.S_ISLNK(os.lstat(tmp_path / "out").st_mode)
    refused = sinks.apply_patches(files, diffs, links, [], [], read_only=True).collect()
    assert {r.said for r in refused} == {"[FATAL] refused: read-only"} and not any(r.written for r in refused)
