"""The window formulation beside a plain stack, on random directive sequences and chosen cases."""

import random

import pytest

from condspark.functions.conditions import ConditionError, evaluate
from condspark.operators import blocks, parts
from condspark.sources import files

LINES = ["#if A", "#ifdef B", "#ifndef A", "#elif B", "#else", "#endif", "x;", "", "y;"]
MACROS = {"A": "1", "C": None}


def by_stack(lines):
    stack, out, ranges, start = [], [], [], None
    for n, line in enumerate(lines, 1):
        word, _, cond = line.lstrip("#").partition(" ") if line.startswith("#") else ("", "", "")
        stray = word in ("elif", "else", "endif") and not stack
        if word in ("if", "ifdef", "ifndef"):
            true = evaluate(cond, MACROS) != (word == "ifndef")
            stack.append([true, true])
        elif word == "elif" and not stray:
            true = evaluate(cond, MACROS)
            stack[-1] = [true and not stack[-1][1], true or stack[-1][1]]
        elif word == "else" and not stray:
            stack[-1] = [not stack[-1][1], True]
        elif word == "endif" and not stray:
            stack.pop()
        active = all(a for a, _ in stack)
        out.append(active)
        if not word or stray:
            if active and start is not None:
                ranges.append((start, n - 1))
                start = None
            elif not active and start is None:
                start = n
    return out, ranges


def test_random_files(spark):
    rng = random.Random(7)
    sources = {f"/f{i}.c": [rng.choice(LINES) for _ in range(rng.randint(0, 30))] + ["end;"] for i in range(120)}
    df = spark.createDataFrame([(p, "t", MACROS, "\n".join(x)) for p, x in sources.items()], "path string, target string, macros map<string,string>, code string")
    states = blocks.line_states(df).cache()
    got, ranges = {}, {}
    for r in states.select("path", "line_no", "active").collect():
        got[r.path, r.line_no] = r.active
    for r in blocks.skipped_ranges(df).collect():
        ranges.setdefault(r.path, []).append((r.lo, r.hi))
    for p, x in sources.items():
        active, skipped = by_stack(x)
        assert [got[p, n] for n in range(1, len(x) + 1)] == active
        assert sorted(ranges.get(p, [])) == skipped


def test_modes(spark):
    code = "a;\n#if A\nb;\n#elif B\nc;\n#else\nd;\n#endif\n#endif\n#if B // note\ne;\n"
    df = spark.createDataFrame([("/a.c", "t", MACROS, code), ("/b.c", "t", {}, "plain;\n"), ("/c.c", "t", {}, "")], "path string, target string, macros map<string,string>, code string")
    assert {r.path: r.code for r in blocks.prune(df).collect()} == {"/a.c": "a;\nb;\n#endif", "/b.c": "plain;", "/c.c": ""}
    folded = {r.path: r.code for r in blocks.prune(df, "virtual").collect()}["/a.c"].split("\n")
    assert folded[:8] == ["a;", "/* [IF A - ACTIVE] */", "b;", "/* [ELIF B - INACTIVE] */", "", "/* [ELSE - INACTIVE] */", "", "/* [ENDIF if] */"]
    assert folded[-1] == "/* [WARN: unclosed directives: if] */"


@pytest.mark.parametrize("bad", ["", "1L", "A <<", "(A) == 1", "defined(", "&&"])
def test_errors(bad):
    with pytest.raises(ConditionError):
        evaluate(bad, {"A": "1"})


@pytest.mark.parametrize("size", [1, 2, 7])
def test_any_cut_into_parts(spark, size):
    """Files told in parts of any size are as told whole, in both modes."""
    rng = random.Random(size)
    made = {f"/f{i}.c": [rng.choice([*LINES, "#endif", "#elif A"]) for _ in range(rng.randint(1, 40))] for i in range(60)}
    df = spark.createDataFrame([(p, "\n".join(x)) for p, x in made.items()], "path string, code string")
    targets = spark.createDataFrame([("t", MACROS), ("u", {"B": "1"})], "target string, macros map<string,string>")
    for mode in ("physical", "virtual"):
        want = {(r.path, r.target): r.code for r in blocks.prune_for(df, targets, mode).collect()}
        got = {}
        for r in sorted(parts.prune(parts.line_parts(df, size), targets, mode).collect(), key=lambda r: r.part):
            got.setdefault((r.path, r.target), []).extend([r.code] if r.n else [])
        assert {k: "\n".join(v) for k, v in got.items()} == want


def test_summaries_compose():
    rng = random.Random(3)
    truth = lambda c: (c in ("A", "1"), None)
    for _ in range(300):
        words = [(rng.choice(["if", "ifdef", "ifndef", "elif", "else", "endif", "endif"]), rng.choice("AB")) for _ in range(rng.randint(0, 14))]
        cut = rng.randint(0, len(words))
        whole = parts.after([], parts.summary(words, truth))
        assert parts.after(parts.after([], parts.summary(words[:cut], truth)), parts.summary(words[cut:], truth)) == whole
        spans, left, _ = blocks._walk([(i, w, c) for i, (w, c) in enumerate(words)], len(words), truth)
        assert ", ".join(b[0] for b in whole) == left and all(b[2] for b in whole) == spans[-1][1]


def test_a_large_file_in_bounded_rows(spark, tmp_path):
    """A file read by splits: rows stay small, and what is shown is what the whole shows."""
    body = "#if A\nkept;\n#else\ngone;\n#endif\n" * 40_000
    (tmp_path / "big.c").write_text("#ifdef A\n" + body + "#else\nnever;\n#endif\nend;\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        cut = files.read_parts(spark, str(tmp_path / "big.c"), 1000)
        targets = spark.createDataFrame([("t", MACROS)], "target string, macros map<string,string>")
        assert cut.count() > 100 and cut.selectExpr("max(length(code))").first()[0] < 10_000
        shown = sorted(parts.prune(cut, targets).where("n > 0").collect(), key=lambda r: r.part)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert "\n".join(r.code for r in shown) == "kept;\n" * 40_000 + "end;"
