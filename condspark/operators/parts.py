"""Conditional blocks of files that are too large for one row, told in parts.

A part knows nothing of the blocks that are open where it begins, but what it does to them is little: it closes some, may
put the next one into another branch, and leaves blocks of its own open.  Such summaries are joined up in the parts'
order, and give each part the blocks that it begins in; then parts are told as whole files are.  What is gathered
for a file is a summary for each part, never its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared
from ..functions import conditions, text
from . import blocks

Block = tuple[str, bool, bool]  # opener, whether a branch was taken, whether this branch is on


class Turn(NamedTuple):
    """What elif and else do to a block: whether one of them held, and whether the last alone did, of a block not taken before."""

    any: bool
    on: bool

    def then(self, yes: bool) -> Turn:
        return Turn(self.any or yes, yes and not self.any)

    def of(self, block: Block) -> Block:
        return block[0], block[1] or self.any, self.on and not block[1]


class Summary(NamedTuple):
    """closed: blocks open before that a part closes; turn: what it does to the next one, if anything; opened: its own."""

    closed: int
    turn: Turn | None
    opened: tuple[Block, ...]


def summary(asked: Iterable[tuple[str, str]], truth: Callable[[str], tuple[bool, str | None]]) -> Summary:
    """The summary of a part with these directives (word, condition)."""
    closed, turn, opened = 0, None, []
    for word, condition in asked:
        yes = truth(condition)[0] if word not in ("else", "endif") else True
        if word in ("if", "ifdef", "ifndef"):
            on = yes != (word == "ifndef")
            opened.append((word, on, on))
        elif opened and word == "endif":
            opened.pop()
        elif word == "endif":
            closed, turn = closed + 1, None
        elif opened:
            opened[-1] = Turn(yes, yes).of(opened[-1])
        else:
            turn = (turn or Turn(False, False)).then(yes)
    return Summary(closed, turn, tuple(opened))


def after(stack: list[Block], part: Summary) -> list[Block]:
    """The open blocks after a part; closers and branches without a block do nothing."""
    left = stack[: max(0, len(stack) - part.closed)]
    if part.turn and left and part.closed < len(stack):
        left = [*left[:-1], part.turn.of(left[-1])]
    return [*left, *part.opened]


_BLOCKS = [(word, taken, on) for word in blocks._OPENERS for taken in (False, True) for on in (False, True)]
_TURNS = [None, *(Turn(any_, on) for any_ in (False, True) for on in (False, True))]
_LETTER = {b: chr(ord("A") + i) for i, b in enumerate(_BLOCKS)}
_BLOCK = {letter: b for b, letter in _LETTER.items()}


def stack_text(stack: Iterable[Block]) -> str:
    """Open blocks as a letter each, as rows hold them."""
    return "".join(_LETTER[tuple(b)] for b in stack)


def summary_text(s: Summary) -> str:
    return f"{s.closed},{_TURNS.index(s.turn)},{stack_text(s.opened)}"


@lru_cache(1 << 14)
def _after_text(stack: str, part: str) -> str:
    closed, turn, opened = part.split(",")
    return stack_text(after([_BLOCK[x] for x in stack], Summary(int(closed), _TURNS[int(turn)], tuple(_BLOCK[x] for x in opened))))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _summaries(asked: pa.Array, keys: pa.Array) -> pa.Array:
    memo, out, counts = conditions.Memo(), [], []
    told = lambda rows, k: summary_text(summary(rows, partial(memo.told, key=k)))
    alike = lru_cache(blocks.KNOWN)(told)
    for rows, own in zip(blocks.text_rows(asked, lambda x: tuple(x.split(" ", 1))), blocks.text_rows(keys), strict=True):
        few = len(rows) <= blocks.ALIKE
        same = tuple(rows) if few else rows
        out += [alike(same, k) if few else told(same, k) for k in own]
        counts.append(len(own))
    return pa.ListArray.from_arrays(blocks.offsets_of(counts), pa.array(out, pa.string()))


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The open blocks before each part, target by target, and whether it is its file's last, of rows by file and part."""
    file, stacks, held = object(), [], None  # held: the row before, as the next one tells whether it is the last
    told = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.list_(pa.string()), pa.bool_()), strict=True)], ["path", "part", "before", "last"])
    for batch in batches:
        before = []
        for path, part, own in zip(*(batch.column(c).to_pylist() for c in ("path", "part", "s")), strict=True):
            if held:
                before.append((*held, held[0] != path))
            if path != file:
                file, stacks = path, [""] * len(own)
            held = path, part, stacks
            stacks = [_after_text(s, x) for s, x in zip(stacks, own, strict=True)]
        if before:
            yield told(before)
    if held:
        yield told([(*held, True)])


@F.arrow_udf(T.ArrayType(blocks._STATES))
def _within(asked: pa.Array, keys: pa.Array, before: pa.Array) -> pa.Array:
    opened = lambda stacks: [tuple(_BLOCK[x] for x in s) for s in stacks]
    return blocks.states_array((rows, own, opened(stacks)) for rows, own, stacks in zip(blocks.text_rows(asked, blocks.asked_text), blocks.text_rows(keys), blocks.text_rows(before), strict=True))


def told(parts: DataFrame, targets: DataFrame) -> DataFrame:
    """(path, part, last, _lines, _found, _t, _all): parts told for all targets (_t) as blocks tells files, with what was open before.

    parts: (path, part, code), cut after line ends, or what cut_lines gives, part ascending within a path; targets:
    (target, macros), few of them.  last marks a file's last part.  Summaries and stacks are a row for each part, whatever
    the number of targets, and a part's lines move once.
    """
    own = blocks.all_targets(targets)
    keys = F.transform("_t", lambda t: t["key"])
    # written, as both sides of the join read it: parts are cut, and their lines and directives found, once
    found = shared.table(blocks.directives(parts).select("path", "part", "_lines", "_found"), "parts")
    summaries = found.select("path", "part", "_found").join(F.broadcast(own)).select("path", "part", _summaries(blocks.asked_texts(), keys).alias("s"))  # one row
    by_file = summaries.repartition("path").sortWithinPartitions("path", "part")
    before = by_file.mapInArrow(_joined_up, "path string, part long, before array<string>, last boolean")
    whole = found.join(before, ["path", "part"]).join(F.broadcast(own))
    return whole.withColumn("_all", _within(blocks.asked_texts(), keys, F.col("before"))).drop("before")


def _shown(parts: DataFrame, targets: DataFrame, mode: str) -> DataFrame:
    """(path, part, _each): for each part an array with what it shows for every target (target, r.code, r.n)."""
    lines = lambda s: blocks.kept_lines(s, mode, F.col("last"))
    shown = lambda s: text.bound(lines(s), lambda kept: F.struct(F.array_join(kept, "\n").alias("code"), F.size(kept).alias("n")))
    each = F.transform(F.arrays_zip(F.col("_t").alias("t"), F.col("_all").alias("s")), lambda e: F.struct(e["t"]["target"].alias("target"), shown(e["s"]).alias("r")))
    return told(parts, targets).select("path", "part", each.alias("_each"))


def prune(parts: DataFrame, targets: DataFrame, mode: str = "physical") -> DataFrame:
    """(path, part, target, code, n): what each part shows; the parts of a file that show lines (n above 0), in order
    and joined by line ends, are what blocks.prune gives of the whole file."""
    rows = _shown(parts, targets, mode).select("path", "part", F.explode_outer("_each").alias("_e")).where("_e is not null")
    return rows.select("path", "part", "_e.target", "_e.r.code", "_e.r.n")


def prune_whole(parts: DataFrame, targets: DataFrame, mode: str = "physical") -> DataFrame:
    """(path, target, code): prune with each file's parts put together again, for files that fit a row.

    A part moves as one row for all targets, whose texts are much alike, and files become rows by target where they are whole.
    """
    rows = _shown(parts, targets, mode).select("path", "part", F.transform("_each", lambda e: e["target"]).alias("_t"), F.transform("_each", lambda e: F.when(e["r"]["n"] > 0, e["r"]["code"])).alias("_c"))
    # dealt out first, as gathering where the parts are would find hardly two of a file
    files = rows.repartition("path").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", "_c", "_t"))).alias("_p"))
    # joining leaves out nulls, parts that show nothing
    whole = lambda t, k: F.struct(t.alias("target"), F.array_join(F.transform("_p", lambda p: F.get(p["_c"], k)), "\n").alias("code"))
    return files.select("path", F.explode(F.transform(F.get("_p", F.lit(0))["_t"], whole)).alias("_e")).select("path", "_e.target", "_e.code")


def line_parts(files: DataFrame, size: int = 10_000) -> DataFrame:
    """(path, part, code): files (path, code) cut into parts of ``size`` lines; for huge files see sources.files.read_parts."""
    return cut_lines(files, size).select("path", "part", F.concat(F.array_join("_lines", "\n"), F.lit("\n")).alias("code"))


def cut_lines(files: DataFrame, size: int = 10_000) -> DataFrame:
    """(path, part, _lines): line_parts with each part's lines, which need not be found again."""
    part = lambda l, k: F.slice(l, k * size + 1, F.lit(size))  # noqa: E731, E741
    cut = lambda l: F.when(F.size(l) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(l) - 1) / size).cast("int")), lambda k: part(l, k)))  # noqa: E731, E741
    # outer, as the filter that Spark derives from a plain one would cut every file twice
    rows = files.select("path", F.posexplode_outer(text.bound(text.split_lines(F.coalesce("code", F.lit(""))), cut)).alias("part", "_lines"))
    return rows.where("part is not null").select("path", F.col("part").cast("long").alias("part"), "_lines")
