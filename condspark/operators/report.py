"""What a reader sees above pruned text: reductions, savings and fixed-width banners, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, tokens

#: The width of a banner's values and its rules.
WIDTH = 36
TOP, BOTTOM = "/* --- {} ---------------------------- */", "/* ------------------------------------------------ */"


def two_places(value: Column) -> Column:
    """A double rounded to two places by its exact binary value, halves to even: 2.675 is 2.67, 0.125 is 0.12."""
    return F.call_function("format_number", value, F.lit("0.00")).cast("double")


def two_places_as_sql(value: Column) -> Column:
    """A double rounded to two places as SQL's round_even does: halves to even of a hundred times it, so 0.025 is 0.02, 2.675 is 2.68."""
    return F.rint(value * 100) / 100


def reduction_pct(original: Column, kept: Column, rounded: Callable[[Column], Column] = two_places) -> Column:
    """Share of lines dropped, in percent; 0 where there are no lines."""
    return F.when(original > 0, rounded((original - kept) / original * 100)).otherwise(0.0)


def savings(before: Column, after: Column, dropped_lines: Column) -> Column:
    """Token estimates of two versions; where the first is null, it counts as the second and a letter a dropped line."""
    a, b = (F.when(x.isNotNull(), tokens.char_estimate(x)) for x in (before, F.coalesce(after, F.lit(""))))
    # that many letters with line ends between them
    stand_in = F.greatest(2 * dropped_lines - 1, F.lit(0))
    letters = F.when(stand_in == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(stand_in / F.lit(tokens.CHARS_PER_TOKEN)))).cast("long")
    saved = F.greatest(a - b, F.lit(0).cast("long"))
    return F.struct(
        F.coalesce(a, b + letters).alias("original_tokens"), b.alias("pruned_tokens"), F.coalesce(saved, F.lit(0).cast("long")).alias("saved_tokens"),
        F.coalesce(F.when(a > 0, two_places(saved / a * 100)), F.lit(0.0)).alias("saved_pct"),
    )


def padded(value: Column, width: int = WIDTH) -> Column:
    """At least ``width`` characters; longer values stay whole."""
    v = value.cast("string")
    return F.concat(v, F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(v), F.lit(0))))


def banner(pruned: DataFrame, title: str, mode: str = "physical", backend: str = "regex", level: Column | None = None, rounded: Callable[[Column], Column] = two_places) -> Column:
    """The banner of each row of prune's result; ``level`` (of budgeted) adds the line of a degraded or long text.

    ``rounded`` gives percentages their two places.
    """
    lost = F.col("original_lines") - F.col("pruned_lines")
    pct = F.when(F.col("original_tokens") > 0, rounded(F.col("saved_tokens") / F.col("original_tokens") * 100)).otherwise(0.0)
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    rows = [  # fixed values: the lines' labels and widths
        F.lit(TOP.format(title)),
        line("/* Target:    ", padded(F.col("target")), "*/"),
        line("/* Lines:     ", lost, "/", F.col("original_lines"), " dropped (", reduction_pct(F.col("original_lines"), F.col("pruned_lines"), rounded), "%)              */"),
        line("/* Tokens:    ", F.col("saved_tokens"), "/", F.col("original_tokens"), " saved (", pct, "%)                  */"),
        F.lit(f"/* Mode:      {mode}                                */"),
        F.lit(f"/* Backend:   {backend}                              */"),
    ]
    if level is not None:
        rows.append(F.when(level == "skeleton", line("/* Degraded: ", padded(level, 32), " */")))
    return F.concat(F.concat_ws("\n", *rows, F.lit(BOTTOM)), F.lit("\n\n"))


def read(pruned: DataFrame, title: str, mode: str = "physical", cap: int = 0, offset: int = 0, rounded: Callable[[Column], Column] = two_places) -> DataFrame:
    """(path, target, text): banner and pruned text, cut by ``text.page`` where ``cap`` is set."""
    whole = F.concat(banner(pruned, title, mode, rounded=rounded), F.col("code"))
    return pruned.select("path", "target", (text.page(whole, F.lit(cap), F.lit(offset)) if cap else whole).alias("text"))


def verdicts(apart: DataFrame, counts: DataFrame, first: int = 20) -> DataFrame:
    """(path, target, agree, said): what active_diff found, in words, for each file of counts (path, target, n_lines)."""
    both = counts.join(apart, ["path", "target"], "left")
    agree = F.coalesce(F.col("only_one") + F.col("only_other"), F.lit(0)) == 0
    some = lambda n, at, label: F.when(F.col(n) > 0, F.concat(F.lit(f"  {label}: ["), F.array_join(at, ", "), F.lit("]"), F.when(F.col(n) > first, "...").otherwise("")))
    said = F.concat_ws("\n", F.concat(F.lit("Disagreement: "), "only_one", F.lit(" line(s) only in the first, "), "only_other", F.lit(" line(s) only in the second.")), some("only_one", "first_one", "first alone"), some("only_other", "first_other", "second alone"))
    return both.select("path", "target", agree.alias("agree"), F.when(agree, F.concat(F.lit("OK: both agree on all "), "n_lines", F.lit(" lines."))).otherwise(said).alias("said"))
