"""What larger tables showed: rounding of ties, work that is done once, work that is dealt out."""

import os

import duckdb
import pytest
from oracle_check import SF, TABLES, differences
from pyspark.sql import functions as F

from condspark.operators import blocks, build, parts, report
from condspark.plans import corpora
from condspark.plans import queries as q


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounded_as_sql(spark):
    d = spark.range(1, 60).select((F.col("id") * 400).alias("b")).select("b", F.explode(F.sequence(F.lit(0), F.col("b"), F.lit(7))).alias("a"))
    rows = d.select("a", "b", report.two_places_as_sql(F.col("a") / F.col("b") * 100).cast("string").alias("x")).toPandas()  # noqa: F841
    assert duckdb.connect().sql("SELECT * FROM rows WHERE x <> round_even(a / b * 100, 2)::VARCHAR LIMIT 3").fetchall() == []


def test_banner_of_a_tie(spark, tmp_path):
    """4000 tokens, of which a count that is 5 in the third place of its percentage is saved."""
    for t in TABLES:
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    os.remove(tmp_path / "documents.parquet")
    docs = [(i, "x" * n, "en", "s", n) for i, n in enumerate(range(14_700, 14_800))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "d"))
    os.symlink(next(tmp_path.glob("d/*.parquet")), tmp_path / "documents.parquet")
    assert differences(spark, q.read_banners, q.ORACLE["read_banners"], str(tmp_path)) == ""


@pytest.mark.parametrize("name", ["unclosed_files", "orphan_directives", "skipped_ranges", "line_report", "prune_synth_lines", "include_walker", "directive_scan", "cond_golden", "cond_templates", "preprocessor_argv"])
def test_dealt_out_and_told_once(spark, name):
    """Keys are dealt out before they become files, and nothing is worked out below that or twice."""
    plan = plan_of(q.QUERIES[name](spark, SF))
    keys = plan.split("REPARTITION_BY_NUM")
    assert len(keys) > 1
    parts = 2 if "Union" in plan else 1  # quoted commands and others
    assert plan.count("ArrowEvalPython") <= parts and "ArrowEvalPython" not in keys[-1]


def test_argv_names_each_step_once(spark):
    """The fold over an entry's words stands once in a row's expression."""
    d = spark.createDataFrame([("w", "/a.c", ["gcc", "-Wall", "-DA=1", "-DA=2", "-D B", "-o", "x.o", "--target=t", "-I", "i", "/a.c"])], "macro_target string, path string, tokens array<string>")
    df = build.preprocessor_argv(d, sysroot="/s")
    assert " ".join(df.first().argv) == "clang -E -w -x c -Wall --target=t i --target=t --sysroot=/s -DA=2 -DB -DW -DTARGET_W -DPRODUCT_W -Ii /a.c"
    assert plan_of(df).count("aggregate(") == 1


def test_spans_of_a_batch_in_slices(spark, monkeypatch):
    """Many files in one batch are told as each is alone, however few are held at once."""
    files = corpora.synth_sources(spark, SF).limit(40)
    whole = files.repartition(1)
    monkeypatch.setattr(blocks, "HELD", 60)
    runs = list(blocks.slices([1, 70, 20, 20, 20, 20], 60))
    assert runs == [(0, 1), (1, 2), (2, 5), (5, 6)]
    told = blocks.line_counts(whole).collect()
    each = [blocks.line_counts(files.where(F.col("path") == r.path)).first() for r in told[:3]]
    assert told[:3] == each and blocks.line_counts(files.limit(0)).count() == 0


def test_pruning_holds_a_byte_a_span(spark):
    """What Python makes of a batch for pruning is a byte for each span and target, and neither lines nor texts go there."""
    asked = [(0, w, c) for w, c in [("ifdef", "A"), ("elif", "B"), ("else", ""), ("endif", ""), ("endif", "")] * 40]
    told = blocks.states_array((asked, ['{"A":null}', "{}"], [None, None]) for _ in range(500))
    assert told.nbytes < 500 * 2 * (len(asked) + 40)
    assert [x["states"][:6] for x in told[0].as_py()] == [[1, 1, 0, 0, 9, 3], [1, 0, 0, 1, 9, 3]]
    plan = plan_of(blocks.prune_for(*corpora.guarded_files(spark, SF)))
    assert plan.count("ArrowEvalPython") == 1 and "_states(" in plan and "struct(at, " not in plan.split("ArrowEvalPython")[1].split("\n")[0]


def test_parts_are_a_row_for_all_targets(spark):
    """A part's text moves once, and it and its summary are a row each, whatever the number of targets."""
    files, targets = corpora.guarded_files(spark, SF)
    cut = parts.line_parts(files.limit(20), 5)
    told = parts.told(cut, targets)
    assert told.count() == cut.count()
    assert "Window" not in plan_of(told)


def test_parts_are_cut_once(spark):
    """Both sides of the join read parts that were written, with their lines; a part moves as one row for all targets."""
    files, targets = corpora.guarded_files(spark, SF)
    files = files.limit(20).unionByName(spark.createDataFrame([("/none", None), ("/blank", "\n\n#if A\nx\n")], "path string, code string")).localCheckpoint()
    for mode in ("physical", "virtual"):
        whole = parts.prune_whole(parts.cut_lines(files.where("code is not null"), 3), targets, mode)
        assert "split(" not in plan_of(whole)
        want = blocks.prune_for(files.where("code is not null"), targets, mode).select("path", "target", "code").collect()
        assert sorted(whole.collect()) == sorted(want)
    moved = plan_of(whole).split("Generate explode")[1]
    assert "Exchange" in moved and "Generate" not in moved


def test_alike_rows_are_told_once(monkeypatch):
    """Rows of few directives that are alike in them, their macros and what was open before are walked once."""
    walked, walk = [], blocks._walk
    monkeypatch.setattr(blocks, "_walk", lambda *a: walked.append(a) or walk(*a))
    asked = [(0, w, c) for w, c in [("elif", "A"), ("else", ""), ("endif", ""), ("endif", "")]]
    before = [("ifdef", False, False)], [("if", True, True), ("ifndef", False, False)]
    told = blocks.states_array((asked, ['{"A":null}', "{}"], [tuple(before[i % 2]), None]) for i in range(500)).to_pylist()
    assert len(walked) == 3 and told[0] == told[498] and told[1] == told[499] and told[0] != told[1]
    assert before[0] == [("ifdef", False, False)]
