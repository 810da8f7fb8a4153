"""Lines, paths and fixed formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every line boundary that text files may have, after CR and CR LF became LF.
BOUNDARY = "[\n\x0b\x0c\x1c-\x1e\x85  ]"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value bound as a lambda's argument, so that it is worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_lines(code: Column) -> Column:
    """Lines without their ends; a final boundary opens no further line."""
    parts = F.split(F.regexp_replace(code, "\r\n?", "\n"), BOUNDARY)
    return bound(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def join_lines(rows: Column) -> Column:
    """Text from an array of (line_no, text) structs in any order."""
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["text"]), "\n")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def normal_path(path: Column) -> Column:
    """Collapses empty, . and .. parts of an absolute path."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, p: F.when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolve(path: Column, directory: Column) -> Column:
    return normal_path(F.when(path.startswith("/"), path).otherwise(F.concat(directory, F.lit("/"), path)))


def page(text: Column, cap: Column, offset: Column) -> Column:
    """Text up to offset + cap characters, cut at a newline past half of the cap; whole if that little is left."""
    off = F.greatest(offset, F.lit(0))
    stop = off + cap
    window = F.substring(text, off + 1, cap)
    back = F.locate("\n", F.reverse(window))
    at = F.when(back > 0, stop - back).otherwise(-1)
    end = F.when(at > off + F.floor(cap / 2), at).otherwise(stop)
    return F.when(F.length(text) - off <= cap, text).otherwise(F.substring(text, F.lit(1), end))


def tagged(severity: Column, message: Column, hint: Column) -> Column:
    """[SEVERITY] message, and the hint on a line of its own if there is one."""
    return F.concat(F.lit("["), severity, F.lit("] "), message, F.when(F.coalesce(hint, F.lit("")) != "", F.concat(F.lit("\n  hint: "), hint)).otherwise(""))


#: Hint of each class of failure.
HINTS = {
    "FileNotFoundError": "check that the file exists and the path is correct",
    "ValueError": "this usually means invalid arguments",
    "TypeError": "this usually means invalid arguments",
    "PermissionError": "the file is not writable; check permissions",
}


def failure(kind: Column, message: Column) -> Column:
    """Tagged text of a failure by its class; unknown classes are plain errors that name it."""
    hint = F.create_map(*[F.lit(x) for kv in HINTS.items() for x in kv])[kind]
    return F.when(hint.isNotNull(), tagged(F.lit("FATAL"), message, hint)).otherwise(F.concat(F.lit("[ERROR] "), kind, F.lit(": "), message))


def path_verdict(path: Column, allow: Column, deny: Column) -> Column:
    """'denied', 'outside' or 'ok'; denial wins, an empty allow list allows all."""
    p = normal_path(path)
    inside = lambda roots: F.exists(roots, lambda r: (p == normal_path(r)) | p.startswith(F.concat(F.regexp_replace(normal_path(r), "/$", ""), F.lit("/"))))
    return F.when(inside(deny), "denied").when((F.size(allow) > 0) & ~inside(allow), "outside").otherwise("ok")


def dot_quote(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('\\"')), F.lit('"'))
