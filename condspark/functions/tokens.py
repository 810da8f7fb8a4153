"""Token estimates and line counts of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters a token of code, tokens a word (inverse), and what parts words.
CHARS_PER_TOKEN = 3.7
WORDS_TO_TOKENS = 1.0 / 1.30
WORD_GAP = r"""[\s\+\-\*/%=<>!&|^~(){}\[\];,.\?:'"#]+"""


def char_estimate(text: Column) -> Column:
    n = F.length(text)
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / F.lit(CHARS_PER_TOKEN)))).cast("long")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, WORD_GAP), lambda w: w != "")).cast("long")


def word_estimate(text: Column) -> Column:
    n = word_count(text)
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n * F.lit(WORDS_TO_TOKENS)))).cast("long")


def estimate(text: Column) -> Column:
    chars, words = char_estimate(text), word_estimate(text)
    return F.struct(
        F.length(text).cast("long").alias("chars"), word_count(text).alias("words"),
        chars.alias("char_estimate"), words.alias("word_estimate"),
        F.floor((chars + words) / 2).cast("long").alias("avg"),
    )


def estimate_pair(before: Column, after: Column) -> Column:
    """Tokens of two versions and what the second saves, never below 0."""
    a, b = char_estimate(before), char_estimate(after)
    saved = F.greatest(F.lit(0).cast("long"), a - b)
    return F.struct(a.alias("original"), b.alias("pruned"), saved.alias("saved"), F.when(a > 0, saved * 100.0 / a).otherwise(0.0).alias("saved_pct"))


def newline_count(text: Column) -> Column:
    """Lines by newline alone: an unfinished last line counts, an empty text has one."""
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (n + F.when(text.endswith("\n"), 0).otherwise(1)).cast("long")
