"""Build databases: flags, macros, include folders, matching files to entries, guessing the target."""

from __future__ import annotations

import re
import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

#: Suffixes of C and C++ units, and of C++ alone once in lower case.
UNIT = r"\.(c|cpp|cc|cxx|C)$"
CPP = [".cpp", ".cc", ".cxx", ".c++"]
#: Macros that name a target, by priority, and the names they go by.
NAMING = ["PRODUCT", "PRODUCT_NAME", "PRODUCT_TYPE", "CHIP", "CHIP_TYPE", "CHIP_NAME", "BUILD_TYPE", "BUILD_VARIANT", "BUILD", "TARGET", "TARGET_NAME", "VARIANT", "BOARD", "BOARD_TYPE"]
CANONICAL = {"PRODUCT_TYPE": "PRODUCT", "CHIP_TYPE": "CHIP", "BOARD_TYPE": "BOARD"}
#: Prefixes of flags to drop, prefixes to keep, whole flags to keep, flags whose value comes next.
DROP = ["-Wl,", "-Wa,", "-Werror", "-save-temps", "-ftime-report", "--param=", "-z", "-static-libgcc", "-static-libstdc++", "-nodefaultlibs", "-nolibc", "-f"]
KEEP = ["-D", "-I", "-isystem", "-iquote", "-include", "--target=", "--sysroot=", "-march=", "-mcpu=", "-mabi=", "-mfloat-abi=", "-mthumb", "-marm", "-f", "-std=", "-W", "-w", "-no-canonical-prefixes", "-pipe", "-pthread"]
KEEP_WHOLE = ["-E", "-c", "-S", "-shared", "-static", "-nostdinc", "-nostdinc++", "-undef", "-x", "-Xclang"]
VALUE_NEXT = ["-I", "-isystem", "-iquote", "-include", "-x"]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _shell(command: pd.Series) -> pd.Series:
    def split(c: str) -> list[str]:
        try:
            return shlex.split(c)
        except ValueError:
            return c.split()

    return command.map(split)


def with_tokens(entries: DataFrame) -> DataFrame:
    """entries with tokens: the arguments, else the command; only quoted commands go through Python."""
    quoted = F.col("command").rlike(r"""["'\\]""")
    plain = F.filter(F.split(F.coalesce("command", F.lit("")), r"\s+"), lambda t: t != "")
    simple = entries.where(F.col("arguments").isNotNull() | F.col("command").isNull() | ~quoted)
    hard = entries.where(F.col("arguments").isNull() & quoted)
    return simple.withColumn("tokens", F.coalesce("arguments", plain)).unionByName(hard.withColumn("tokens", _shell("command")))


def macros_of(tokens: Column) -> Column:
    """Map of -D macros by first mention, the last value of equal names counting; one without '=' has a null value."""
    parts = F.transform(F.filter(tokens, lambda t: t.startswith("-D")), lambda t: F.trim(F.substring(t, F.lit(3), F.length(t))))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.when(p.contains("="), F.trim(F.substring(p, F.locate("=", p) + 1, F.length(p)))).alias("v")))
    last = lambda own, n: F.element_at(F.filter(own, lambda p: p["k"] == n), -1)["v"]
    by_name = lambda own: text.bound(F.array_distinct(F.transform(own, lambda p: p["k"])), lambda names: F.map_from_arrays(names, F.transform(names, lambda n: last(own, n))))
    return text.bound(pairs, by_name)


def include_dirs_of(tokens: Column) -> Column:
    """Folders of -Idir and -I dir, in order."""
    found = F.transform(tokens, lambda t, i: F.when((t == "-I") & (i + 1 < F.size(tokens)), F.get(tokens, i + 1)).when(t.startswith("-I") & ((i == 0) | (F.get(tokens, i - 1) != "-I")), F.substring(t, F.lit(3), F.length(t))))
    return F.filter(found, lambda d: d.isNotNull())


def target_macros(target: Column) -> Column:
    upper = F.upper(target)
    return F.map_from_arrays(F.array(upper, F.concat(F.lit("TARGET_"), upper), F.concat(F.lit("PRODUCT_"), upper)), F.array(*[F.lit(None).cast("string")] * 3))


def union_macros(first: Column, over: Column) -> Column:
    """Both maps; where both have a name, that of over."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(over, k)), over)


def match_files(files: DataFrame, entries: DataFrame, by_name: bool = True, units_only: bool = True) -> DataFrame:
    """files (path) with what each database has for them: its first entry of the same path or the same file name.

    A row for each file and database (entries' db_id) that has such an entry; a file that no database knows keeps one row
    of nulls.  Files that name a db_id themselves are looked up in that one alone.  Order (entry_ord) counts within a
    database.  Each path and each file name keeps a database's first entry alone before the equi-joins, so a
    name that many files and entries share makes one row a file and database.
    """
    if "db_id" not in entries.columns:  # one database
        return match_files(files, entries.withColumn("db_id", F.lit("")), by_name, units_only).drop("db_id")
    own = entries.withColumn("entry_path", text.resolve(F.col("file"), F.col("directory")))
    if units_only:
        own = own.where(F.col("file").rlike(UNIT))
    entry = F.struct(*entries.columns)
    first = lambda k: own.groupBy("db_id", k.alias("_k")).agg(F.min_by(entry, "entry_ord").alias("_e"))
    within = ["path", "db_id"] if "db_id" in files.columns else ["path"]
    asked = files.select(*within).distinct()
    keyed = lambda k: asked.withColumn("_k", k)
    met = keyed(text.normal_path(F.col("path"))).join(first(F.col("entry_path")), ["_k", *within[1:]]).select("path", "db_id", "_e")
    if by_name:
        met = met.unionByName(keyed(text.basename(F.col("path"))).join(first(text.basename(F.col("file"))), ["_k", *within[1:]]).select("path", "db_id", "_e"))
    best = met.groupBy("path", "db_id").agg(F.min_by("_e", "_e.entry_ord").alias("_e"))
    out = files.join(best if len(within) > 1 else best.drop("db_id"), within, "left")
    return out.select(*files.columns, *[F.col(f"_e.{c}").alias(c) for c in entries.columns if c not in files.columns])


def include_folders(files: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, db_id, ord, dir): the include folders that each database gives a file, by its path alone.

    A relative folder is one of the file's own folder.
    """
    met = with_tokens(match_files(files.select("path"), entries, by_name=False, units_only=False).where("db_id is not null"))
    folder = met.select("path", "db_id", F.posexplode(include_dirs_of(F.col("tokens"))).alias("ord", "dir"))
    return folder.select("path", "db_id", "ord", text.resolve(F.col("dir"), text.dirname(F.col("path"))).alias("dir"))


def macros_by_file(entries: DataFrame) -> DataFrame:
    """(db_id, file, macros) with a database's last entry of each file."""
    return with_tokens(entries).groupBy("db_id", "file").agg(F.max_by("tokens", "entry_ord").alias("tokens")).select("db_id", "file", macros_of(F.col("tokens")).alias("macros"))


def infer_target(entries: DataFrame) -> DataFrame:
    """(db_id, target, votes): the commonest name by the first naming macro of each entry; ties to the first seen."""
    said = F.coalesce(F.when(F.coalesce("command", F.lit("")) != "", F.col("command")), F.array_join("arguments", " "), F.lit(""))
    names = F.regexp_extract_all(said, F.lit(r"-D([A-Za-z_][A-Za-z0-9_]*)(?:=([^\s]+))?"), F.lit(1))
    values = F.regexp_extract_all(said, F.lit(r"-D([A-Za-z_][A-Za-z0-9_]*)(?:=([^\s]+))?"), F.lit(2))
    rank = F.array(*[F.lit(n) for n in NAMING])
    seen = F.filter(F.transform(names, lambda n, i: F.struct(F.array_position(rank, n).alias("p"), i.alias("i"), n.alias("n"), F.get(values, i).alias("v"))), lambda s: s["p"] > 0)
    best = F.array_min(seen)
    called = F.coalesce(F.create_map(*[F.lit(x) for kv in CANONICAL.items() for x in kv])[best["n"]], best["n"])
    value = F.regexp_replace(F.when(F.coalesce(best["v"], F.lit("")) == "", F.lit("1")).otherwise(best["v"]), r"""^['"]+|['"]+$""", "")
    votes = entries.select("db_id", "entry_ord", F.when(F.size(seen) > 0, F.concat(called, F.lit("_"), value)).otherwise("DEFAULT").alias("target"))
    counted = votes.groupBy("db_id", "target").agg(F.count("*").alias("votes"), F.min("entry_ord").alias("seen"))
    return counted.groupBy("db_id").agg(F.max_by(F.struct("target", "votes"), F.struct("votes", -F.col("seen"))).alias("t")).select("db_id", "t.target", "t.votes")


def keep_flags(tokens: Column) -> Column:
    """The flags that don't disturb preprocessing, with the values that follow them.

    What each word is by itself is told before one fold, which finds the values.
    """
    prefix = lambda table: "^(?:" + "|".join(map(re.escape, table)) + ")"
    # the first prefix in the table's order, as alternatives are tried in theirs
    first = F.transform(tokens, lambda t: F.struct(t.alias("t"), F.regexp_extract(t, prefix(KEEP), 0).alias("p")))
    kept = lambda x: ~x["t"].rlike(prefix(DROP)) & ((x["p"] != "") | x["t"].isin(KEEP_WHOLE))
    takes = lambda x: F.when(x["p"] != "", x["p"]).otherwise(x["t"]).isin(VALUE_NEXT)
    told = F.transform(first, lambda x: F.struct(x["t"].alias("t"), kept(x).alias("kept"), takes(x).alias("takes")))

    def step(state: Column, x: Column) -> Column:
        out, value = state["out"], state["value"]
        return F.struct(F.when(value | x["kept"], F.concat(out, F.array(x["t"]))).otherwise(out).alias("out"), (~value & x["kept"] & x["takes"]).alias("value"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("value"))
    return F.aggregate(told, start, step, lambda s: s["out"])


def is_cpp(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1)).isin(CPP)


def preprocessor_argv(entries: DataFrame, compiler: str = "clang", target: str = "", sysroot: str = "") -> DataFrame:
    """entries (path, macro_target, file, directory, tokens) with argv: the words that would preprocess path.

    Flags of the entry that don't disturb preprocessing come first, without its macros, include folders, output and
    source; then target and sysroot (given, else the entry's), the entry's macros, the target's three where the entry has
    none of that name, the include folders and the file.  A null entry (tokens) gives none of its own.
    """
    return entries.withColumn("argv", text.bound(F.coalesce("tokens", F.array().cast("array<string>")), lambda own: _argv(own, compiler, target, sysroot)))


def _argv(own: Column, compiler: str, target: str, sysroot: str) -> Column:
    """The words for an entry's tokens ``own``; what is named more than once is bound, so each is worked out once a row."""
    word = lambda t: (t == "-o") | (t == "--output")
    sources = r"^/.*\.(c|cpp|cc|cxx|C|h|hpp)$"
    no_output = lambda kept: F.filter(kept, lambda t, i: ~word(t) & ~F.coalesce((i > 0) & word(F.get(kept, i - 1)), F.lit(False)) & ~t.rlike(sources))
    plain = F.filter(text.bound(keep_flags(own), no_output), lambda t: ~t.rlike("^-(D|I|isystem|iquote|include)"))
    inherited = lambda rest, flag: F.try_element_at(F.filter(rest, lambda t: t.startswith(flag)), F.lit(-1))
    option = lambda rest, flag, given: F.array_compact(F.array(F.lit(f"{flag}{given}") if given else inherited(rest, flag)))
    options = lambda rest: F.concat(rest, option(rest, "--target=", target), option(rest, "--sysroot=", sysroot))
    every = lambda macros: F.map_concat(macros, F.map_filter(target_macros(F.col("macro_target")), lambda k, _: ~F.map_contains_key(macros, k)))
    defined = F.transform(F.map_entries(text.bound(macros_of(own), every)), lambda e: F.concat(F.lit("-D"), e["key"], F.when(e["value"].isNotNull(), F.concat(F.lit("="), e["value"])).otherwise("")))
    language = F.when(is_cpp(F.col("path")), "c++").otherwise("c")
    begin = F.array(F.lit(compiler), F.lit("-E"), F.lit("-w"), F.lit("-x"), language)
    folders = F.transform(include_dirs_of(own), lambda d: F.concat(F.lit("-I"), d))
    return F.concat(begin, text.bound(plain, options), defined, folders, F.array("path"))
