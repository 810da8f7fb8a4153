"""Walks kept between runs: only files that changed are read anew, only walks that met a change go anew.

A snapshot holds each file's hash.  A change of a file, or of what one of its headers leads to (a file that came or went can
be found before another), touches the file; a walk is touched if it visited a touched file, which the kept visits
tell, the closure of includes the other way round.  All other walks stand as they are.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared
from . import walk


class State(NamedTuple):
    """snapshot: (path, hash); lines: what walk.placed gave; walked: the walks; all of them written tables."""

    snapshot: DataFrame
    lines: DataFrame
    walked: walk.Walk


class Refreshed(NamedTuple):
    """The new state, the files (path, change) that came, went or changed, and the walks (root, target) that went anew."""

    state: State
    changed: DataFrame
    redone: DataFrame


def _kept(walked: walk.Walk) -> walk.Walk:
    return walk.Walk(*[shared.table(part, name) for part, name in zip(walked, walk.Walk._fields, strict=True)])


def _snapshot(files: DataFrame) -> DataFrame:
    return shared.table(files.select("path", F.sha2(F.coalesce("code", F.lit("")).cast("binary"), 256).alias("hash")), "snapshot")


def begin(files: DataFrame, dirs: DataFrame, roots: DataFrame, targets: DataFrame, max_depth: int = 10) -> State:
    """The state after walking everything; arguments as for walk.walk."""
    lines = walk.placed(walk.told_lines(files, targets), files, dirs)
    there = roots.join(files.select(F.col("path").alias("root")).distinct(), "root", "left_semi").distinct()
    return State(_snapshot(files), lines, _kept(walk.walk_lines(lines, there, max_depth)))


def refresh(state: State, files: DataFrame, dirs: DataFrame, roots: DataFrame, targets: DataFrame, max_depth: int = 10) -> Refreshed:
    """The state for files as they are now, equal to what begin gives for them.

    Targets, include folders and depth must be those of the state; roots may come and go.
    """
    new = _snapshot(files)
    both = new.join(state.snapshot.withColumnRenamed("hash", "before"), "path", "full")
    change = F.when(F.col("before").isNull(), "came").when(F.col("hash").isNull(), "went").when(F.col("hash") != F.col("before"), "changed")
    changed = shared.table(both.select("path", change.alias("change")).where("change is not null"), "changed")
    anew = files.join(changed.where("change <> 'went'").select("path"), "path", "left_semi")
    same = state.lines.drop("dst").join(changed.select("path"), "path", "left_anti")
    lines = walk.placed(same.unionByName(walk.told_lines(anew, targets)), files, dirs)
    # files that stayed but whose headers lead elsewhere now
    keys = ["path", "target", "line_no", "header"]
    moved = lines.where("header is not null").join(state.lines.select(*keys, F.col("dst").alias("old"), F.lit(True).alias("known")), keys).where("not (dst <=> old)")
    touched = shared.table(changed.select("path").unionByName(moved.select("path")).distinct(), "touched")
    there = roots.join(files.select(F.col("path").alias("root")).distinct(), "root", "left_semi").distinct()
    met = state.walked.visits.join(touched, "path", "left_semi").select("root", "target").distinct()
    # an ended walk read the file where it ended, which it visited; new roots have no visit yet
    known = state.walked.visits.where("depth = 0").select("root", "target")
    redone = shared.table(there.join(met, ["root", "target"], "left_semi").unionByName(there.join(known, ["root", "target"], "left_anti")), "redone")
    stands = there.join(redone, ["root", "target"], "left_anti")
    fresh = walk.walk_lines(lines, redone, max_depth)
    parts = [old.join(stands, ["root", "target"], "left_semi").unionByName(now) for old, now in zip(state.walked, fresh, strict=True)]
    return Refreshed(State(new, lines, _kept(walk.Walk(*parts))), changed, redone)
