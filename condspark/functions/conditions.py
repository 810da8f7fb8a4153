"""The language of #if conditions, evaluated once for each distinct one of an Arrow batch.

The language is lenient on purpose: unknown characters vanish, names are compared without case,
'!' binds looser than comparison, and a parenthesised operand at the start of a logical term
can't be compared or added to.  Errors never fail a query: they come as text beside a false result.
"""

from __future__ import annotations

import json
import operator
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"\s+|(0[xX][0-9a-fA-F]+|\d+\.\d*|\.\d+|\d+)|(\bdefined\b)|([A-Za-z_]\w*)|(==|!=|<=|>=|&&|\|\||<<|>>|[<>=+\-*/%!()\[\],])", re.ASCII)
PROBE = re.compile(r"\b(?:is_enabled|is_builtin|isc_enabled)\s*\(\s*([A-Za-z_]\w*)\s*\)", re.IGNORECASE)
COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}
SUM = {"+": operator.add, "-": operator.sub}
PRODUCT = {"*": operator.mul, "/": lambda a, b: a // (b or 1), "%": lambda a, b: a % (b or 1)}


class ConditionError(ValueError):
    pass


def number_of(value: str | None) -> float:
    """A macro's value as a number; one without a value, or with another text, is 1."""
    if value is None:
        return 1
    for read in (lambda v: int(v, 0), float):
        try:
            return read(value)
        except ValueError:
            pass
    return 1


class _Reader:
    """Binding powers from loose to tight: || && then ! and groups, then comparison, sum, product."""

    def __init__(self, text: str, macros: dict[str, str | None]):
        self.macros = macros
        self.tokens = [m.groups() for m in TOKEN.finditer(PROBE.sub(r"defined(\1)", text)) if m.lastindex]
        self.at = 0

    def operator(self) -> str | None:
        return self.tokens[self.at][3] if self.at < len(self.tokens) else None

    def take(self, *wanted: str) -> str | None:
        found = self.operator()
        if found is not None and found in wanted:
            self.at += 1
            return found
        return None

    def need(self, what: str) -> None:
        if not self.take(what):
            raise ConditionError(f"missing {what!r}")

    def whole(self):
        if not self.tokens:
            raise ConditionError("empty condition")
        value = self.any_of()
        if self.at < len(self.tokens):
            raise ConditionError("trailing tokens")
        return bool(value)

    def any_of(self):
        value = self.all_of()
        while self.take("||"):
            right = self.all_of()
            value = value or right
        return value

    def all_of(self):
        value = self.term()
        while self.take("&&"):
            right = self.term()
            value = value and right
        return value

    def term(self):
        if self.take("!"):
            return not self.term()
        return self.group() if self.operator() == "(" else self.comparison()

    def group(self):
        self.need("(")
        value = self.any_of()
        self.need(")")
        return value

    def comparison(self):
        left = self.chain(SUM, lambda: self.chain(PRODUCT, self.atom))
        if sign := self.take(*COMPARE):
            return COMPARE[sign](left, self.chain(SUM, lambda: self.chain(PRODUCT, self.atom)))
        return left

    def chain(self, table: dict, part):
        value = part()
        while sign := self.take(*table):
            value = table[sign](value or 0, part() or 0)
        return value

    def atom(self):
        if self.at >= len(self.tokens):
            raise ConditionError("unexpected end")
        number, probe, name, sign = self.tokens[self.at]
        if sign == "(":
            return self.group()
        if sign is not None:
            raise ConditionError(f"unexpected {sign!r}")
        self.at += 1
        if number is not None:
            return int(number, 16) if number[:2] in ("0x", "0X") else float(number) if "." in number else int(number)
        if probe is not None:
            wrapped = self.take("(")
            if self.at >= len(self.tokens) or self.tokens[self.at][2] is None:
                raise ConditionError("defined needs a name")
            self.at += 1
            if wrapped:
                self.need(")")
            return self.tokens[self.at - (2 if wrapped else 1)][2].lower() in self.macros
        if self.take("("):  # a call: its arguments don't count
            depth = 1
            while depth and self.at < len(self.tokens):
                depth += {"(": 1, ")": -1}.get(self.operator(), 0)
                self.at += 1
            return int(name.lower() in self.macros)
        return number_of(self.macros[name.lower()]) if name.lower() in self.macros else 0


def normal_macros(macros: dict[str, str | None]) -> dict[str, str | None]:
    """Names in lower case, the last of equal ones counting; other than numeric values in lower case."""
    return {k.lower(): v if v is None or re.fullmatch(r"\s*[+-]?(0[xX][0-9a-fA-F]+|\d+(\.\d*)?)\s*", v) else v.lower() for k, v in macros.items()}


def evaluate(condition: str, macros: dict[str, str | None]) -> bool:
    return _Reader(condition, normal_macros(macros)).whole()


def told(condition: str, normal: dict[str, str | None]) -> tuple[bool, str | None]:
    """(result, error) by macros that normal_macros gave; an error leaves the result false."""
    try:
        return _Reader(condition, normal).whole(), None
    except (ConditionError, OverflowError, ZeroDivisionError, TypeError) as e:
        return False, str(e)


class Memo:
    """Results of conditions by the values of the names that they hold, so macro sets that differ in other names share them.

    Sets are given as macro_key makes them and read once each.  ``asked`` counts evaluations.
    """

    def __init__(self):
        self.sets: dict[str, dict] = {}
        self.names: dict[str, list[str]] = {}
        self.known: dict[tuple, tuple[bool, str | None]] = {}
        self.by_set: dict[tuple[str, str], tuple[bool, str | None]] = {}
        self.asked = 0

    def told(self, condition: str, key: str) -> tuple[bool, str | None]:
        if (key, condition) in self.by_set:
            return self.by_set[key, condition]
        if key not in self.sets:
            self.sets[key] = normal_macros(json.loads(key))
        if condition not in self.names:
            self.names[condition] = sorted({n.lower() for n in re.findall(r"[A-Za-z_]\w*", condition)})
        macros = self.sets[key]
        about = condition, tuple((n, macros[n]) for n in self.names[condition] if n in macros)
        if about not in self.known:
            self.asked += 1
            self.known[about] = told(condition, macros)
        self.by_set[key, condition] = self.known[about]
        return self.known[about]


@F.pandas_udf(T.StructType().add("result", T.BooleanType()).add("error", T.StringType()))
def _evaluated(condition: pd.Series, macros: pd.Series) -> pd.DataFrame:
    memo = Memo()
    return pd.DataFrame([memo.told(c, k) if c is not None else (None, None) for c, k in zip(condition, macros, strict=True)], columns=["result", "error"])


def macro_key(macros: Column) -> Column:
    """A macro map as text that keeps nulls and the map's order, as the last of names equal but for case counts."""
    entries = F.map_entries(macros)
    quoted = lambda c: F.to_json(F.array(c), {"ignoreNullFields": "false"})
    body = F.transform(entries, lambda e: F.concat(F.regexp_extract(quoted(e["key"]), r"^\[(.*)\]$", 1), F.lit(":"), F.coalesce(F.regexp_extract(quoted(e["value"]), r"^\[(.*)\]$", 1), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(body, ","), F.lit("}"))


def with_results(rows: DataFrame, condition: str = "condition", key: str = "macro_key") -> DataFrame:
    """rows with cond_result and cond_error, both null where there is no condition.

    Each distinct pair of an Arrow batch is evaluated once, so no row has to be moved.
    """
    told = rows.withColumn("_e", _evaluated(F.col(condition), F.col(key)))
    return told.withColumns({"cond_result": F.col("_e.result"), "cond_error": F.col("_e.error")}).drop("_e")
