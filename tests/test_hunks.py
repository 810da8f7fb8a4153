"""Diffs as rows beside the fold, over random diffs that fit, fail, overlap and lie."""

import random

from condspark.operators import hunks, patch


def made(rng, lines):
    """A diff of a few hunks, mostly right."""
    out, at, moved = ["--- a", "+++ b"], 1, 0
    for _ in range(rng.randint(0, 4)):
        at += rng.choice([0, 1, 2, 5]) if rng.random() < 0.9 else -rng.randint(0, 3)
        body, old, new, k = [], 0, 0, at - 1
        for _ in range(rng.randint(0, 4)):
            kind = rng.choice(" -+")
            if kind == "+":
                body.append(f"+new{rng.randint(0, 9)}")
                new += 1
                continue
            line = lines[k] if 0 <= k < len(lines) and rng.random() < 0.97 else "other"
            body.append(kind + line if line or kind == "-" or rng.random() < 0.5 else "")
            k, old, new = k + 1, old + 1, new + (kind == " ")
        a, b = (old, new) if rng.random() < 0.93 else (old + 1, new)
        head = f"@@ -{at},{a} +{at + moved},{b} @@" if (a, b) != (1, 1) or rng.random() < 0.5 else f"@@ -{at} +{at + moved} @@"
        out += [head + rng.choice(["", "", "", " ", " int f()"]), *body, *rng.choice([[], [], ["\\ No newline at end of file"]])]
        if rng.random() < 0.05:
            out += ["--- other", "+++ other", "-not read"]
        at, moved = at + old, moved + b - a
    return "\n".join(out) + rng.choice(["", "\n"])


def test_hunks_as_rows_beside_the_fold(spark):
    rng = random.Random(12)
    rows = []
    for i in range(500):
        lines = [rng.choice(["a", "b", "", "c c", "-d", "+e"]) for _ in range(rng.randint(0, 12))]
        rows.append((f"/{i}", "\n".join(lines) + rng.choice(["", "\n"]), made(rng, lines)))
    rows += [("/none", "a\n", "no diff"), ("/null", None, "@@ -1,0 +1,1 @@\n+x\n"), ("/nodiff", "a\n", None)]
    d = spark.createDataFrame(rows, "path string, code string, diff string")
    want = {}
    for path, code, diff in rows:
        try:
            want[path] = (patch.apply_diff(code or "", diff or ""), None)
        except patch.PatchError as e:
            want[path] = (None, str(e))
    got = hunks.apply_diffs(d.select("path", "code"), d.select("path", "diff")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.patched, r.error) == want[r.path], dict((p, (c, f)) for p, c, f in rows)[r.path]
    fine = sum(e is None for _, e in want.values())
    assert 60 < fine < 450 and hunks.placed(hunks.hunk_rows(d)).where("not plain").count() > 5
