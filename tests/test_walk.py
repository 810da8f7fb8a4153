"""Depth-first walks beside a plain recursion over random trees, and the graphs they leave."""

import json
import posixpath
import random

import pytest

from condspark.functions import conditions
from condspark.operators import includes, incremental, walk

MACROS = {"on": {"A": "1", "B": None}, "off": {}}


def tree(rng, n, bad):
    """{path: lines} of n headers whose names repeat in three folders."""
    names = [f"/r/d{i % 3}/h{i // 3}.h" for i in range(n)]
    files = {}
    for path in names:
        lines = []
        for _ in range(rng.randint(0, 6)):
            other = rng.choice(names)
            said = rng.choice([posixpath.basename(other), posixpath.relpath(other, posixpath.dirname(path)), other, "none.h"])
            lines += rng.choice([[], ["#if A"], ["#ifdef B"], ["#else"], ["#elif A == 1"], ["#endif"], ["#ifndef B"], ["int x;"], *([["#if 1L"]] if rng.random() < bad else [])])
            lines.append(f'#include "{said}"')
        files[path] = lines
    return files


class Ended(Exception):
    pass


def plain(files, dirs, root, macros, bound):
    """(visits, events, error, lists by name in the order they came in) of one walk."""
    visits, events, graph = [], [], {}

    def resolve(said, by):
        for place in [said] if said.startswith("/") else [posixpath.join(posixpath.dirname(by), said), *(posixpath.join(d, said) for d in dirs)]:
            if posixpath.normpath(place) in files:
                return posixpath.normpath(place)
        return None

    def open_(path, depth):
        if depth >= bound or path in [v for v, _ in visits]:
            return
        visits.append((path, depth))
        name, stack = posixpath.basename(path), []
        graph[name] = []
        for k, line in enumerate(files[path], 1):
            word, _, rest = line.lstrip("#").partition(" ")
            if line.startswith("#") and word != "include":
                outer = all(stack[:-1])
                if word in ("if", "ifdef", "ifndef") or (word == "elif" and stack and outer):
                    yes, error = conditions.told(rest, conditions.normal_macros(macros))
                    if error:
                        raise Ended((path, k, error))
                if word in ("if", "ifdef", "ifndef"):
                    stack.append(all(stack) and yes != (word == "ifndef"))
                elif stack and word == "elif" and outer:
                    stack[-1] = not stack[-1] and yes
                elif stack and word == "else":
                    stack[-1] = outer and not stack[-1]
                elif stack and word == "endif":
                    stack.pop()
            elif word == "include":
                said = rest.strip('"')
                on, to = all(stack), resolve(said, path)
                events.append((path, k, said, on, to))
                graph[name].append(said if on else said + " [skipped]")
                if on and to:
                    open_(to, depth + 1)

    try:
        open_(root, 0)
    except Ended as e:
        return visits, events, e.args[0], graph
    return visits, events, None, graph


def led(graph, root):
    """(nodes with depth, edges) from the root's name, last header first."""
    seen, stack, depth, edges = {}, [root], {root: 0}, []
    while stack:
        node = stack.pop()
        if node in seen:
            continue
        seen[node] = depth[node]
        for dep in graph.get(node, []):
            edges.append((node, dep))
            if dep not in seen:
                depth[dep] = depth[node] + 1
                stack.append(dep)
    return seen, edges


@pytest.mark.parametrize(("seed", "bound", "bad"), [(1, 3, 0), (2, 9, 0.3)])
def test_walks_beside_recursion(spark, seed, bound, bad):
    rng = random.Random(seed)
    files = tree(rng, 18, bad)
    dirs = ["/r/d1", "/r/d2"]
    f = spark.createDataFrame([(p, "\n".join(x)) for p, x in files.items()], "path string, code string")
    targets = spark.createDataFrame([(k, v) for k, v in MACROS.items()], "target string, macros map<string,string>")
    roots = spark.createDataFrame([(p, t) for p in [*files, "/r/none.c"] for t in MACROS], "root string, target string")
    got = walk.walk(f, spark.createDataFrame(list(enumerate(dirs)), "ord int, dir string"), roots, targets, bound)
    order = lambda rows: sorted(rows, key=lambda r: (r.root, r.target, r.label))
    visits, events, errors = order(got.visits.collect()), order(got.events.collect()), {(r.root, r.target): (r.path, r.line_no, r.error) for r in got.errors.collect()}
    named = walk.name_graph(got)
    graphs = {(r.root, r.target): json.loads(r.json) for r in walk.graph_json(named).collect()}
    stats = {(r.root, r.target): (r.total_files, r.max_depth, r.total_edges) for r in walk.graph_stats(named).collect()}
    drawn = {(r.root, r.target): r.dot.split("\n") for r in walk.graph_dot(named).collect()}
    near = {(r.root, r.target, r.path) for r in walk.followed(got).collect()}
    resolved = {(r.root, r.target, r.name): r.path for r in named.collect()}
    ended = 0
    for root in files:
        for t, macros in MACROS.items():
            own, met, error, graph = plain(files, dirs, root, macros, bound)
            assert [(r.path, r.depth) for r in visits if (r.root, r.target) == (root, t)] == own
            assert [(r.path, r.line_no, r.header, r.active, r.dst) for r in events if (r.root, r.target) == (root, t)] == met
            assert errors.get((root, t)) == error
            ended += error is not None
            name = posixpath.basename(root)
            seen, edges = led(graph, name)
            assert graphs[root, t] == {"root": name, "nodes": list(seen), "edges": [{"from": a, "to": b} for a, b in edges]}
            assert stats[root, t] == (len(seen), max(seen.values()), sum(map(len, graph.values())))
            arrows = [f'  "{a}" -> "{b}";' for a, deps in graph.items() for b in deps]
            loose = sorted({b for deps in graph.values() for b in deps} - set(graph))
            assert drawn[root, t] == ["digraph G {", '  rankdir="LR";', "  node [shape=box];", f'  "{name}" [style=filled, fillcolor=lightblue];', *arrows, *[f'  "{b}" [style=dashed];' for b in loose], "}"]
            assert {p for r, g, p in near if (r, g) == (root, t)} == {to for *_, on, to in met if on and to and to != root}
            for p, _ in own:
                assert resolved[root, t, posixpath.basename(p)] == [x for x, _ in own if posixpath.basename(x) == posixpath.basename(p)][-1]
    assert (ended > 0) == (bad > 0)


def test_walks_of_nothing(spark):
    files = spark.createDataFrame([("/a.h", None), ("/b.h", '#include "a.h"')], "path string, code string")
    targets = spark.createDataFrame([("t", {"A": "1"})], "target string, macros map<string,string>")
    dirs = spark.createDataFrame([], "ord int, dir string")
    roots = spark.createDataFrame([("/b.h", "t"), ("/none.h", "t")], "root string, target string")
    assert [(r.path, r.label) for r in walk.walk(files, dirs, roots, targets, 1).visits.collect()] == [("/b.h", [])]
    assert walk.walk(files, dirs, roots, targets, 0).visits.count() == 0
    assert walk.walk(files, dirs, roots.limit(0), targets, 3).visits.count() == 0
    full = walk.walk(files, dirs, roots, targets, 2)
    assert sorted((r.path, r.depth) for r in full.visits.collect()) == [("/a.h", 0 + 1), ("/b.h", 0)]
    lines = includes.walked_includes(spark.createDataFrame([("/x.h", '#include "a.h"\n#if (\n#include "b.h"')], "path string, code string").crossJoin(targets))
    assert [(r.line_no, r.active) for r in lines.collect()] == [(1, True)]


def test_refresh_equals_a_full_run(spark):
    """Files that change, come and go; only walks that met them go anew."""
    rng = random.Random(5)
    files = tree(rng, 15, 0.05)
    dirs = spark.createDataFrame([(0, "/r/d1")], "ord int, dir string")
    targets = spark.createDataFrame([(k, v) for k, v in MACROS.items()], "target string, macros map<string,string>")
    table = lambda f: spark.createDataFrame([(p, "\n".join(x)) for p, x in f.items()], "path string, code string")
    rooted = lambda f: spark.createDataFrame([(p, t) for p in f for t in MACROS], "root string, target string")
    state = incremental.begin(table(files), dirs, rooted(files), targets, 4)
    for k in range(2):
        now = dict(files)
        changed = rng.choice(sorted(now))
        now[changed] = [x for x in now[changed] if "include" not in x] + ["int more;"]
        if k:
            del now[rng.choice(sorted(set(now) - {changed}))]
            now["/r/d0/none.h"] = ["int found;"]  # what could not be found is
        seen = {(r.root, r.target): set() for r in state.walked.visits.collect()}
        for r in state.walked.visits.collect():
            seen[r.root, r.target].add(r.path)
        state, apart, redone = incremental.refresh(state, table(now), dirs, rooted(now), targets, 4)
        full = walk.walk(table(now), dirs, rooted(now), targets, 4)
        for got, want in zip(state.walked, full, strict=True):
            assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
        assert {r.path for r in apart.collect()} == {p for p in files.keys() | now.keys() if files.get(p) != now.get(p)}
        if not k:
            assert {(r.root, r.target) for r in redone.collect()} == {w for w, paths in seen.items() if changed in paths}
        files = now


def test_conditions_are_asked_once_for_the_values_they_name():
    memo = conditions.Memo()
    sets = [json.dumps({"A": str(i % 2), f"OTHER_{i}": "1", "b": None}) for i in range(100)]
    for condition in ("A == 1", "defined(B) && !A", "NONE", "A <<"):
        for k in sets:
            assert memo.told(condition, k) == conditions.told(condition, conditions.normal_macros(json.loads(k)))
    assert memo.asked == 2 + 2 + 1 + 2
