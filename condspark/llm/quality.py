"""Line-first cleaning with DataFrame functions only.

Every line is judged by itself: punctuation (a short line ends a sentence, no line shouts),
navigation (link bars, breadcrumbs) and boilerplate (legal and site phrases).  Failing
lines go, then a document that lost too large a part of its words is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Java's \s is [\t-\r ], the separators of the word contract
WORD_GAP = r"\s+"
#: Phrases of lines that are no content.
BOILERPLATE = [
    "all rights reserved", "copyright", "cookie", "privacy policy", "terms of use", "terms of service", "enable javascript",
    "click here", "subscribe", "sign up", "log in", "lorem ipsum", "licensed under", "share this",
    "alle rechte vorbehalten", "datenschutz", "impressum", "nutzungsbedingungen", "hier klicken",
    "tous droits réservés", "mentions légales", "politique de confidentialité", "cliquez ici",
    "todos los derechos reservados", "aviso legal", "política de privacidad", "haga clic",
]
#: A phrase stands alone, but for a plural or a past form.
PHRASE = rf"\b({'|'.join(BOILERPLATE)})(s|d)?\b"
ENDS = """[.!?:;…\"'”’)]"""
SYMBOLS = "#*$%&|<>"


def _array(sql: str) -> Column:
    return F.expr(sql)


def line_rules(line: Column) -> dict[str, Column]:
    """Each rule's verdict on a line that has a word: true where it fails."""
    bars = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    shouts = F.size(F.split(line, r"[!?]{2}")) - 1
    words = F.size(F.filter(F.split(line, WORD_GAP), lambda w: w != ""))
    return {
        "punctuation": (~line.rlike(rf"{ENDS}\s*$") & (words < 10)) | (shouts * 3 > words),
        "navigation": (bars >= 2) | line.rlike(r"(\s[>»/]\s.*){2}"),
        "boilerplate": F.lower(line).rlike(PHRASE),
    }


def line_fails(line: Column) -> Column:
    rules = line_rules(line)
    return rules["navigation"] | rules["boilerplate"] | rules["punctuation"]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = 0.5, min_words: int = 20, max_repeat: float = 0.3) -> DataFrame:
    """Measure, clean and judge every document.

    Returns (id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines,
    n_lines_removed, n_words_kept, clean_text, kept).  base_failed: fewer than min_words words, or more
    than max_repeat of them in 8-word windows found twice in the text.  kept: not base_failed, and
    the lines removed hold at most max_lost of the words.  A null text is empty, so it fails; repeated
    rows give repeated results, an empty table none, and a very long text is measured whole.  Other columns are ignored.
    Windows are compared by 64-bit hash within a document.
    """
    d = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    d = d.select(
        "_id", "_t",
        F.expr(r"filter(split(_t, '\\s+'), w -> w <> '')").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"\S")).alias("_l"),
    )
    d = d.withColumns({
        "_n": F.size("_w").cast("long"),
        "_h": F.transform("_w", lambda w: F.xxhash64(w)),
        "_clean": F.filter("_l", lambda x: ~line_fails(x)),
    })
    for name, of, step in (("_h2", "_h", 1), ("_h4", "_h2", 2), ("_h8", "_h4", 4)):
        d = d.withColumn(name, _array(f"zip_with(slice({of}, 1, greatest(size({of}) - {step}, 0)), slice({of}, {step + 1}, greatest(size({of}) - {step}, 0)), (a, b) -> xxhash64(a, b))"))
    d = d.withColumn("_again", _array("size(array_distinct(_h8)) < size(_h8)"))
    d = d.withColumn("_sorted", _array("case when _again then sort_array(transform(_h8, (h, i) -> struct(h, i))) else array() end"))
    d = d.withColumn(
        "_places",
        _array("""case when _again then sort_array(array_distinct(flatten(zip_with(
            slice(_sorted, 1, size(_sorted) - 1), slice(_sorted, 2, size(_sorted) - 1),
            (a, b) -> case when a.h = b.h then array(a.i, b.i) else array() end)))) else array() end"""),
    )
    repeat = _array("""case when _again then aggregate(zip_with(
        slice(_places, 1, size(_places) - 1), slice(_places, 2, size(_places) - 1),
        (a, b) -> least(b - a, 8)), 8L, (s, x) -> s + x) else 0L end""")
    d = d.withColumns({"_repeat": repeat, "_kept_words": F.aggregate("_clean", F.lit(0).cast("long"), lambda s, x: s + F.size(F.split(F.trim(F.regexp_replace(x, WORD_GAP, " ")), " ")))})
    failed = (F.col("_n") < min_words) | (F.col("_repeat") > max_repeat * F.col("_n"))
    if abs(max_repeat * 100 - round(max_repeat * 100)) < 1e-9:  # whole percents in integers
        failed = (F.col("_n") < min_words) | (100 * F.col("_repeat") > round(max_repeat * 100) * F.col("_n"))
    lost = F.col("_n") - F.col("_kept_words")
    return d.select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.col("_repeat").alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size("_clean")).cast("long").alias("n_lines_removed"),
        F.col("_kept_words").alias("n_words_kept"),
        F.array_join("_clean", "\n").alias("clean_text"),
        (~failed & (lost <= max_lost * F.col("_n"))).alias("kept"),
    )
