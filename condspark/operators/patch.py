"""Unified diffs and a light syntax check, one file at a time within Arrow batches."""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .skeleton import lines_of

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)$")
_IFS = ("if", "ifdef", "ifndef")
_SYNTAX = re.compile(r"\\.?|[\"'{}]|//|/\*|\*/")


#: Texts of the two warnings at the end of a file.
BRACES_OPEN = "unbalanced braces: depth={} at end of file"
IFS_OPEN = "unbalanced #if/#endif: {} unmatched #if at end of file"


class PatchError(ValueError):
    pass


class Hunk(NamedTuple):
    at: int
    grows: int
    body: list[str]


def hunks_of(diff: str) -> list[Hunk]:
    """Hunks in order; a heading becomes a context line, counts are trusted, '\\' notes are left out."""
    found: list[Hunk] = []
    inside = False
    for line in lines_of(diff):
        if m := _HUNK.match(line):
            counts = [int(m[i]) if m[i] is not None else 1 for i in (2, 4)]
            found.append(Hunk(int(m[1]), counts[1] - counts[0], [" " + m[5].strip()] if m[5].strip() else []))
            inside = True
        elif line.startswith(("---", "+++")):
            inside = False
        elif inside and not line.startswith("\\"):
            found[-1].body.append(line if line[:1] in (" ", "-", "+") and line else " " + line)
    if not found:
        raise PatchError("diff contains no hunks")
    return found


def apply_diff(code: str, diff: str) -> str:
    """code with every hunk applied; context and removed lines must match exactly.

    A later hunk moves by what the counts of those before add.
    """
    lines, shift = lines_of(code), 0
    for hunk in hunks_of(diff):
        first = hunk.at + shift - 1
        if not 0 <= first <= len(lines):
            raise PatchError(f"hunk starts at line {first + 1}, outside the file")
        old = [x[1:] for x in hunk.body if x[0] != "+"]
        have = lines[first : first + len(old)]
        for k, want in enumerate(old):
            if k >= len(have):
                raise PatchError(f"hunk wants line {first + k + 1}, past the end")
            if have[k] != want:
                raise PatchError(f"hunk mismatch at line {first + k + 1}")
        lines[first : first + len(old)] = [x[1:] for x in hunk.body if x[0] != "-"]
        shift += hunk.grows
    return "\n".join(lines) + "\n" * code.endswith("\n")


def syntax_warnings(code: str) -> list[str]:
    """Stray or open conditional directives and unbalanced braces.

    After the first line comment braces no longer count, as in the checker whose results this keeps.
    """
    found, braces, chain, within, skip = [], 0, [], "", False
    for n, line in enumerate(lines_of(code), 1):
        head = line.strip()
        if head.startswith("#"):
            word = (head[1:].split() or [""])[0]
            if word in _IFS:
                chain.append(word)
            elif word in ("elif", "else", "endif"):
                if not chain or (word == "else" and chain[-1] == "else"):
                    found.append(f"line {n}: #{word} without matching #if")
                elif word == "else":
                    chain[-1] = "else"
                elif word == "endif":
                    chain.pop()
            continue
        at = int(skip)
        skip = False
        while within != "//" and (m := _SYNTAX.search(line, at)):
            at, mark = m.end(), m[0]
            if mark[0] == "\\":
                skip = len(mark) == 1
            elif within == "/*":
                if mark == "*/":
                    within = ""
                else:
                    at = m.start() + 1
            elif within:
                if mark == within:
                    within = ""
                at = m.start() + 1
            elif mark in ("//", "/*", '"', "'"):
                within = mark
            elif mark == "{":
                braces += 1
            elif mark == "}":
                braces -= 1
            else:
                at = m.start() + 1
    if braces:
        found.append(BRACES_OPEN.format(braces))
    if chain:
        found.append(IFS_OPEN.format(len(chain)))
    return found


@F.pandas_udf(T.StructType().add("patched", T.StringType()).add("error", T.StringType()))
def patched(code: pd.Series, diff: pd.Series) -> pd.DataFrame:
    def one(c: str, d: str) -> tuple[str | None, str | None]:
        try:
            return apply_diff(c or "", d or ""), None
        except PatchError as e:
            return None, str(e)

    return pd.DataFrame([one(c, d) for c, d in zip(code, diff, strict=True)], columns=["patched", "error"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def syntax(code: pd.Series) -> pd.Series:
    return code.map(lambda c: syntax_warnings(c or ""))
