"""Skeletons: declarations stay whole, function bodies become a stub.

A file is read as a run of segments (a line, a declaration with its block, a function), each found by a
recogniser at the segment's first line, and the segments are then rendered.  The scan is sequential
within a file, so it is one Arrow-batched function a file.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands for a body, words that open a block to keep, lines looked ahead for a head and for its brace.
STUB = "{ /* ... */ }"
DECLARES = ("struct", "union", "enum", "typedef", "extern")
HEAD_LINES, BRACE_LINES = 5, 10
COUNTS = ("original_lines", "skeleton_lines", "functions_stripped", "lines_removed")
SCHEMA = T.StructType([T.StructField("skeleton", T.StringType()), *(T.StructField(c, T.LongType()) for c in COUNTS)])

_LINES = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
_BLOCK_WORD = re.compile(rf"\s*(?:{'|'.join(DECLARES)})[ \t]")
_NO_HEAD = re.compile(r"\s*(?:#|//|/\*|(?:struct|union|enum|typedef) )")
_QUOTED = r"{0}(?:\\\n*[^\n]|[^{0}\\])*+(?:{0}|\\?\n*\Z)"
#: A brace, or something that hides braces: an escape, a string or character (over line ends too), a comment (to its line's end at most).
_BRACE = re.compile("|".join([r"\\\n*[^\n]", _QUOTED.format('"'), _QUOTED.format("'"), r"//[^\n]*", r"/\*[^\n]*?\*/", r"/\*[^\n]*", r"(?P<brace>[{}])"]))
_STEP = {"(": 1, ")": -1}


def lines_of(code: str) -> list[str]:
    parts = _LINES.split(code)
    return parts[:-1] if parts[-1] == "" else parts


class Segment(NamedTuple):
    last: int
    head: int | None = None  # of a function: the line of its brace
    closed: bool = True


class _Source:
    def __init__(self, lines: list[str]):
        self.lines = lines

    @cached_property
    def text(self) -> str:
        return "\n".join(self.lines)

    @cached_property
    def starts(self) -> list[int]:
        return [0, *accumulate(len(x) + 1 for x in self.lines)]

    def block_end(self, n: int) -> int | None:
        """Line of the brace that closes the first block begun on line n or after it."""
        depth = 0
        for m in _BRACE.finditer(self.text, self.starts[n]):
            if m["brace"]:
                depth += 1 if m["brace"] == "{" else -1
                if m["brace"] == "}" and not depth:
                    return bisect.bisect_right(self.starts, m.start()) - 1
        return None

    def brace_line(self, n: int, within: int) -> int | None:
        return next((i for i, x in enumerate(self.lines[n : n + within], n) if "{" in x), None)


def _declaration(source: _Source, n: int) -> Segment | None:
    end = source.block_end(n) if _BLOCK_WORD.match(source.lines[n]) else None
    return None if end is None else Segment(end)


def _function(source: _Source, n: int) -> Segment | None:
    """A head whose parentheses close before a brace that no semicolon precedes, all within a few lines."""
    if _NO_HEAD.match(source.lines[n]):
        return None
    near = source.brace_line(n, HEAD_LINES)
    marks = re.findall("[(){;]", "".join(source.lines[n : n + HEAD_LINES if near is None else near + 1]))
    begun = marks.index("(") if "(" in marks else len(marks)
    depths = accumulate(_STEP.get(m, 0) for m in marks)
    ends = [m for i, (m, depth) in enumerate(zip(marks, depths, strict=True)) if i > begun and m in "{;" and not depth]
    if ends[:1] != ["{"]:
        return None
    head = source.brace_line(n, BRACE_LINES)
    end = source.block_end(head)
    return Segment(head, head, False) if end is None else Segment(end, head)


def _segments(source: _Source) -> Iterator[tuple[int, Segment]]:
    n = 0
    while n < len(source.lines):
        plain = re.match(r"\s*(?:#|$)", source.lines[n])
        segment = None if plain else _declaration(source, n) or _function(source, n)
        yield n, segment or Segment(n)
        n = (segment.last if segment else n) + 1


def skeletonize(code: str) -> tuple[str, int, int, int, int]:
    """(skeleton, original lines, skeleton lines, functions stripped, lines removed).

    A function of one line keeps its text before the stub; one whose block doesn't close has its head stubbed
    and goes on with the next line.
    """
    source = _Source(lines_of(code))
    out: list[str] = []
    stripped = removed = 0
    for n, segment in _segments(source):
        if segment.head is None:
            out += source.lines[n : segment.last + 1]
            continue
        out += [re.sub(r"\s*\{$", "", " ".join(" ".join(source.lines[n : segment.head + 1]).split())), STUB]
        stripped += segment.closed
        removed += max(0, segment.last - segment.head - 1)
    return "\n".join(out), len(source.lines), sum(bool(x.strip()) for x in out), stripped, removed


@F.pandas_udf(SCHEMA)
def skeleton(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([skeletonize(c or "") for c in code], columns=["skeleton", *COUNTS])
