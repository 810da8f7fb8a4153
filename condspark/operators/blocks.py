"""Conditional blocks: which lines are active, told within each file's row.

A file's lines are split where the file is; its directives alone go to a function that walks them with a
stack of open blocks and tells runs of lines (spans) of one state.  The first true branch of a block
wins, stray closers do nothing, and a line is active where all blocks around it are.  Text is never moved:
pruning and folding filter the split lines in place, and no step shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, partial
from itertools import accumulate, chain, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import conditions, text, tokens

#: The conditional directives and includes, as patterns.
DIRECTIVE = r"^\s*#\s*(ifdef|ifndef|if|elif|else|endif)\b\s*(.*)"
INCLUDE = r"""^\s*#\s*include\s*[<"]([^>"]+)[>"]"""
FILE = ["path", "target"]
_SPAN = {"n": T.IntegerType(), "active": T.BooleanType(), "depth": T.LongType(), "level": T.LongType(), "orphan": T.BooleanType(), "closes": T.StringType(), "error": T.StringType()}
_OPENERS = ("if", "ifdef", "ifndef")


def _condition(line: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(line, DIRECTIVE, 2), r"(?U)\s+$", "")


def _directive(line: Column) -> Column:
    """(directive, condition) of a line, or null."""
    # most lines hold no '#' and skip the pattern
    word = F.regexp_extract(line, DIRECTIVE, 1)
    found = F.struct(word.alias("directive"), _condition(line).alias("condition"))
    return F.when(line.contains("#"), F.when(word != "", found))


def lines(files: DataFrame) -> DataFrame:
    """(all columns but code, line_no, text, directive, condition) of every line."""
    keep = [c for c in files.columns if c != "code"]
    rows = files.select(*keep, F.posexplode_outer(text.split_lines(F.col("code"))).alias("_n", "text")).where("_n is not null")
    rows = rows.select(*keep, (F.col("_n") + 1).alias("line_no"), "text", _directive(F.col("text")).alias("_d"))
    return rows.select(*keep, "line_no", "text", "_d.directive", "_d.condition")


class _Lines:
    """Runs of inactive code lines up to before the next active one, and the number of active lines of code."""

    def __init__(self):
        self.ranges: list[tuple[int, int]] = []
        self.active = self.opened = 0

    def add(self, first: int, last: int, active: bool) -> None:
        if first > last:
            return
        if active:
            self.active += last - first + 1
            if self.opened:
                self.ranges.append((self.opened, first - 1))
                self.opened = 0
        elif not self.opened:
            self.opened = first


def _walk(asked: list[tuple[int, str, str]], total: int, truth, begin: Iterable[Iterable] | None = None) -> tuple[list[tuple], str, _Lines]:
    """Spans of a file of ``total`` lines with directives (line, word, condition), the blocks left open, and its lines of code.

    truth(condition) gives (result, error).  A condition that can't be evaluated is false.  ``begin``: blocks open before.
    """
    at = [d[0] for d in asked] + [total]
    open_ = [list(b) for b in begin or ()]  # [opener, whether a branch was taken, whether this branch is on]
    active = all(b[2] for b in open_)
    spans, code = [(at[0], active, len(open_), None, False, None, None)], _Lines()
    code.add(1, at[0], active)
    for k, (line, word, condition) in enumerate(asked):
        result, error = truth(condition) if word not in ("else", "endif") else (True, None)
        yes = not result if word == "ifndef" else bool(result)
        stray, level, closes = word not in _OPENERS and not open_, len(open_), None
        if word in _OPENERS:
            open_.append([word, yes, yes])
            level += 1
        elif stray:
            level = 0
        elif word == "endif":
            closes = open_.pop()[0]
        else:
            block = open_[-1]
            block[2], block[1] = yes and not block[1], block[1] or yes
        active = all(b[2] for b in open_)
        spans.append((at[k + 1] - line, active, len(open_), level, stray, closes, error))
        code.add(line + (1 if stray else 2), at[k + 1], active)  # line counts from 0
    return spans, ", ".join(b[0] for b in open_), code


_FILE = {"open": T.StringType(), "lo": T.ArrayType(T.IntegerType()), "hi": T.ArrayType(T.IntegerType()), "active_lines": T.LongType()}
_SPANS = T.StructType([*(T.StructField(k, T.ArrayType(v)) for k, v in _SPAN.items()), *(T.StructField(k, v) for k, v in _FILE.items())])


_TYPES = {"n": pa.int32(), "active": pa.bool_(), "depth": pa.int64(), "level": pa.int64(), "orphan": pa.bool_(), "closes": pa.string(), "error": pa.string()}
#: Directives, times macro sets, whose spans are held as Python values at once; an Arrow batch has no bound of that kind.
HELD = 100_000


def shared_texts(texts: pa.Array) -> list[str]:
    """The texts of an Arrow array, equal ones as one object."""
    coded = texts.dictionary_encode()
    known = coded.dictionary.to_pylist()
    return [None if i is None else known[i] for i in coded.indices.to_pylist()]


def slices(weights: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of rows of about ``most`` in all; a heavier row is a run of its own."""
    begin, held = 0, 0
    for i, w in enumerate(weights):
        if held and held + w > most:
            yield begin, i
            begin, held = i, 0
        held += w
    if begin < len(weights):
        yield begin, len(weights)


def offsets_of(counts: list[int]) -> pa.Array:
    return pa.array(list(accumulate(counts, initial=0)), pa.int32())


def spans_array(walked: list[tuple[list[tuple], str, _Lines]]) -> pa.StructArray:
    """What _walk told of each file, as an Arrow array of _SPANS."""
    ends = offsets_of([len(spans) for spans, *_ in walked])
    columns = zip(*chain.from_iterable(spans for spans, *_ in walked), strict=True) if walked else [[]] * len(_TYPES)
    told = [pa.ListArray.from_arrays(ends, pa.array(list(c), t)) for c, t in zip(columns, _TYPES.values(), strict=True)]
    runs = offsets_of([len(code.ranges) for *_, code in walked])
    side = lambda k: pa.ListArray.from_arrays(runs, pa.array([r[k] for *_, code in walked for r in code.ranges], pa.int32()))
    file = [pa.array([left for _, left, _ in walked], pa.string()), side(0), side(1), pa.array([code.active for *_, code in walked], pa.int64())]
    return pa.StructArray.from_arrays([*told, *file], [*_TYPES, *_FILE])


def asked_rows(asked: pa.ListArray, fields: tuple[str, ...]) -> list[list[tuple]]:
    """Each row's structs as tuples of these fields."""
    flat = asked.flatten()
    column = lambda c: shared_texts(c) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c.to_pylist()
    every = list(zip(*[column(flat.field(f)) for f in fields], strict=True))
    ends = list(accumulate(asked.value_lengths().to_pylist(), initial=0))
    return [every[i:j] for i, j in pairwise(ends)]


@F.arrow_udf(T.ArrayType(_SPANS))
def _spans(total: pa.Array, asked: pa.Array, keys: pa.Array) -> pa.Array:
    """For each of a file's macro sets its spans.  asked: arrays of (line, directive, condition) structs.

    Each condition is evaluated once for the values of its names, and a file's directives are unpacked once for all sets.
    Whatever a batch holds, its spans are Python values for some of its files at a time.
    """
    memo = conditions.Memo()
    sets = [k.as_py() for k in keys]
    out = []
    for i, j in slices([(n + 1) * len(own) for n, own in zip(asked.value_lengths().to_pylist(), sets, strict=True)], HELD):
        rows = zip(total[i:j].to_pylist(), asked_rows(asked[i:j], ("at", "directive", "condition")), sets[i:j], strict=True)
        walked = spans_array([_walk(found, n, partial(memo.told, key=k)) for n, found, own in rows for k in own])
        out.append(pa.ListArray.from_arrays(offsets_of([len(own) for own in sets[i:j]]), walked))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(spans_array([]).type))


_STATES = T.StructType().add("states", T.ArrayType(T.ByteType())).add("open", T.StringType())


def text_rows(texts: pa.ListArray, of: Callable[[str], object] = lambda x: x) -> Iterator[list]:
    """Each row's texts, row by row, as what ``of`` makes of each distinct one; only the row at hand is a list."""
    coded = texts.flatten().dictionary_encode(null_encoding="encode")
    known = [of(x) for x in coded.dictionary.to_pylist()]
    at, begin = coded.indices.to_numpy(zero_copy_only=False), 0
    for n in texts.value_lengths().to_pylist():
        yield [known[i] for i in at[begin : begin + n].tolist()]
        begin += n


def asked_texts() -> Column:
    """The directives of ``_found`` as texts, without their lines."""
    return F.transform("_found", lambda d: F.concat(d["directive"], F.lit(" "), d["condition"]))


def asked_text(x: str) -> tuple[int, str, str]:
    """A text of asked_texts as _walk takes it, on no line."""
    return (0, *x.split(" ", 1))


#: Rows of so many directives at most, of a batch so many, are told once where they are alike.
ALIKE, KNOWN = 64, 1 << 14


def states_array(rows: Iterable[tuple[list[tuple[int, str, str]], list[str], Iterable[tuple | None]]]) -> pa.Array:
    """For each row (directives, keys, blocks open before) and key the spans' states, a byte each, and the blocks left open.

    A byte tells whether the span is active (1), whether its directive is stray (2), and from 4 on the number of the opener
    that it closes.  Where spans begin and end is known from the directives, so nothing else is held of a file.
    """
    memo, every, lengths, opens, counts = conditions.Memo(), bytearray(), [], [], []

    def told(asked, key: str, begin: tuple | None) -> tuple[bytes, str]:
        spans, left, _ = _walk(asked, 0, partial(memo.told, key=key), begin)
        return bytes(s[1] + 2 * s[4] + 4 * (_OPENERS.index(s[5]) + 1 if s[5] else 0) for s in spans), left

    alike = lru_cache(KNOWN)(told)
    for asked, keys, begins in rows:
        few = len(asked) <= ALIKE
        same = tuple(asked) if few else asked
        for k, begin in zip(keys, begins, strict=True):
            states, left = alike(same, k, begin) if few else told(same, k, begin)
            every += states
            lengths.append(len(states))
            opens.append(left)
        counts.append(len(keys))
    flat = pa.Array.from_buffers(pa.int8(), len(every), [None, pa.py_buffer(every)])
    told = pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets_of(lengths), flat), pa.array(opens, pa.string())], ["states", "open"])
    return pa.ListArray.from_arrays(offsets_of(counts), told)


@F.arrow_udf(T.ArrayType(_STATES))
def _states(asked: pa.Array, keys: pa.Array) -> pa.Array:
    return states_array((found, own, [None] * len(own)) for found, own in zip(text_rows(asked, asked_text), text_rows(keys), strict=True))


def marked_lines(lines: Column) -> Column:
    """(at, x, word) of the lines that hold a '#', word being the directive or empty; its pattern runs once a line."""
    marked = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("x"))), lambda d: d["x"].contains("#"))
    return F.transform(marked, lambda d: F.struct(d["at"].alias("at"), d["x"].alias("x"), F.regexp_extract(d["x"], DIRECTIVE, 1).alias("word")))


def directives(files: DataFrame) -> DataFrame:
    """files with _lines, if they lack them, and _found, their directives; null code has no lines."""
    rows = files if "_lines" in files.columns else files.withColumn("_lines", text.split_lines(F.coalesce("code", F.lit(""))))
    found = F.filter(marked_lines(F.col("_lines")), lambda d: d["word"] != "")
    return rows.withColumn("_found", F.transform(found, lambda d: F.struct(d["at"].alias("at"), d["word"].alias("directive"), _condition(d["x"]).alias("condition"))))


def directive_lines(files: DataFrame) -> DataFrame:
    """(all columns but code, line_no, directive, condition) of every directive; other lines become no rows."""
    keep = [c for c in files.columns if c != "code"]
    rows = directives(files).select(*keep, F.explode_outer("_found").alias("d")).where("d is not null")
    return rows.select(*keep, (F.col("d.at") + 1).alias("line_no"), "d.directive", "d.condition")


def _parsed(files: DataFrame, keys: Column) -> DataFrame:
    """files with directives and _all, spans for each of ``keys``."""
    return directives(files).withColumn("_all", _spans(F.size("_lines"), F.col("_found"), keys))


def _told(files: DataFrame) -> DataFrame:
    """files (with macros) with _lines, _found and _s, the spans and what is told of the whole file."""
    return _parsed(files, F.array(conditions.macro_key(F.col("macros")))).withColumn("_s", F.get("_all", F.lit(0))).drop("_all")


def _by_line(row: str = "_s") -> Column:
    """For every line its span's state, head being true on the directive that begins a span."""
    spans = F.arrays_zip(*[F.col(f"{row}.{c}").alias(c) for c in _SPAN])
    of = lambda s, k: F.transform(F.sequence(F.lit(1), s["n"]), lambda j: F.struct(((k > 0) & (j == 1)).alias("head"), k.alias("span"), s["active"].alias("active"), s["depth"].alias("depth"), s["level"].alias("level"), s["orphan"].alias("orphan"), s["closes"].alias("closes"), s["error"].alias("error")))
    empty = F.array().cast("array<struct<head:boolean,span:int,active:boolean,depth:bigint,level:bigint,orphan:boolean,closes:string,error:string>>")
    return F.flatten(F.transform(spans, lambda s, k: F.when(s["n"] > 0, of(s, k)).otherwise(empty)))


def with_lines(rows: DataFrame) -> DataFrame:
    """What _told gave with _rows: an array of (text, state, directive, condition) for every line."""
    both = F.zip_with("_lines", _by_line(), lambda x, s: F.struct(x.alias("text"), s.alias("s"), F.when(s["head"], F.get("_found", s["span"] - 1)).alias("d")))
    return rows.withColumn("_rows", both)


def line_states(files: DataFrame) -> DataFrame:
    """Lines of (path, target, macros, code) with depth, active and what their directive does.

    A condition that can't be evaluated is false, so its #ifndef is true.  Null code has no lines.
    """
    keep = [c for c in files.columns if c not in ("code", "macros")]
    # outer, as the filter that Spark derives from a plain one would work out every line twice
    rows = with_lines(_told(files)).select(*keep, F.posexplode_outer("_rows").alias("_n", "r")).where("_n is not null")
    head = lambda c: F.when(F.col("r.s.head"), F.col(f"r.s.{c}"))
    return rows.select(
        *keep, (F.col("_n") + 1).alias("line_no"), "r.text", "r.d.directive", "r.d.condition", F.col("r.s.depth").alias("depth"), head("level").alias("level"),
        F.coalesce(head("orphan"), F.lit(False)).alias("orphan"), F.col("r.s.active").alias("active"), head("closes").alias("closes"), head("error").alias("cond_error"),
    )


def _mark(directive: Column, condition: Column, closes: Column, active: Column) -> Column:
    """What the folded text shows in place of a directive."""
    state = F.when(active, "ACTIVE").otherwise("INACTIVE")
    return (
        F.when(directive == "endif", F.concat(F.lit("/* [ENDIF "), closes, F.lit("] */")))
        .when(directive == "else", F.concat(F.lit("/* [ELSE - "), state, F.lit("] */")))
        .otherwise(F.concat(F.lit("/* ["), F.upper(directive), F.lit(" "), condition, F.lit(" - "), state, F.lit("] */")))
    )


def shown(states: DataFrame, mode: str = "physical") -> DataFrame:
    """Lines as they are shown: physical drops, virtual blanks and marks.  Stray directives stay."""
    plain = F.col("directive").isNull() | F.col("orphan")
    if mode == "physical":
        return states.where(plain & F.col("active"))
    mark = _mark(F.col("directive"), F.col("condition"), F.col("closes"), F.col("active"))
    return states.withColumn("text", F.when(~plain, mark).when(F.col("active"), F.col("text")).otherwise(""))


def skipped_ranges(files: DataFrame) -> DataFrame:
    """(path, target, lo, hi) of files as for line_states: inactive runs of code lines up to before the next active one.

    A run that no active code line follows isn't reported.  Told within a file's row.
    """
    ranges = F.arrays_zip(F.col("_s.lo").alias("lo"), F.col("_s.hi").alias("hi"))
    return _told(files).select(*FILE, F.explode(ranges).alias("r")).select(*FILE, "r.lo", "r.hi")


def unclosed(files: DataFrame) -> DataFrame:
    """(path, target, kinds) of files as for line_states: the blocks still open at the end, outermost first."""
    # a row of an array, as Spark would work out a plain column's file twice, for the filter and for what it keeps
    return _told(files).select(*FILE, F.explode_outer(F.array("_s.open")).alias("kinds")).where("kinds <> ''")


def strays(files: DataFrame) -> DataFrame:
    """(path, target, line_no, directive) of files as for line_states: directives that belong to no block.

    Told within a file's row, whose other lines become no rows.
    """
    # the span after a directive is the one with its number
    stray = F.filter(F.transform("_found", lambda d, i: F.struct((d["at"] + 1).alias("line_no"), d["directive"].alias("directive"), F.get("_s.orphan", i + 1).alias("orphan"))), lambda d: d["orphan"])
    rows = _told(files).select(*FILE, F.explode_outer(stray).alias("r")).where("r is not null")
    return rows.select(*FILE, "r.line_no", "r.directive")


def line_counts(files: DataFrame) -> DataFrame:
    """(path, target, active_lines, skipped_ranges) of files as for line_states; active lines are lines of code."""
    return _told(files).select(*FILE, F.col("_s.active_lines").alias("active_lines"), F.size("_s.lo").cast("long").alias("skipped_ranges"))


def prune(files: DataFrame, mode: str = "physical") -> DataFrame:
    """(path, target, code, original_lines, pruned_lines, original_tokens, pruned_tokens, saved_tokens).

    files: (path, target, macros, code), one row for each file and target; null code is empty.  No step moves
    a row.  pruned_lines counts the lines that aren't blank.
    """
    own = F.array(F.struct("target", conditions.macro_key(F.col("macros")).alias("key")))
    return _pruned(directives(files.select("path", "code", own.alias("_t"))), mode)


def prune_for(files: DataFrame, targets: DataFrame, mode: str = "physical") -> DataFrame:
    """prune of every file (path, code) for every target (target, macros).

    A file's lines are split and its directives found once, whatever the number of targets; the targets' macros, one
    small row, go along with every file.
    """
    return _pruned(directives(files.select("path", "code")).join(F.broadcast(all_targets(targets))), mode)  # one row


def all_targets(targets: DataFrame) -> DataFrame:
    """One row with _t, the targets and the keys of their macros."""
    return targets.select(F.struct("target", conditions.macro_key(F.col("macros")).alias("key")).alias("t")).agg(F.array_sort(F.collect_list("t")).alias("_t"))


def kept_lines(told: Column, mode: str, last: Column | None = None) -> Column:
    """The lines of ``_lines`` that are shown by what states_array told.

    A span's lines are taken as a whole, but for the directive before them.  Folded, blocks left open are told at the end
    (of the ``last`` part of a file).
    """
    states = told["states"]
    begin = lambda k: F.coalesce(F.get("_found", k)["at"], F.size("_lines"))
    active, stray = (lambda s: s.bitwiseAND(F.lit(1).cast("byte")) != 0), (lambda s: s.bitwiseAND(F.lit(2).cast("byte")) != 0)
    first = lambda k: F.when(k > 0, begin(k - 1)).otherwise(0)
    rest = lambda s, k: first(k) + F.when((k > 0) & ~stray(s), 1).otherwise(0)  # past a directive that isn't shown
    text_of = lambda s, k: text.bound(rest(s, k), lambda x: F.slice("_lines", x + 1, begin(k) - x))
    if mode == "physical":
        return F.flatten(F.transform(states, lambda s, k: F.when(active(s), text_of(s, k)).otherwise(F.array().cast("array<string>"))))
    opener = lambda s: F.get(F.array(*[F.lit(x) for x in _OPENERS]), F.shiftright(s.cast("int"), 2) - 1)
    mark = lambda s, k: text.bound(F.get("_found", k - 1), lambda d: F.array(_mark(d["directive"], d["condition"], opener(s), active(s))))
    head = lambda s, k: F.when((k > 0) & ~stray(s), mark(s, k)).otherwise(F.array().cast("array<string>"))
    body = lambda s, k: F.when(active(s), text_of(s, k)).otherwise(F.array_repeat(F.lit(""), begin(k) - rest(s, k)))
    kept = F.flatten(F.transform(states, lambda s, k: F.concat(head(s, k), body(s, k))))
    ends = told["open"] != "" if last is None else last & (told["open"] != "")
    return F.concat(kept, F.when(ends, F.array(F.concat(F.lit("/* [WARN: unclosed directives: "), told["open"], F.lit("] */")))).otherwise(F.array().cast("array<string>")))


def _pruned(rows: DataFrame, mode: str) -> DataFrame:
    """rows: (path, code, _lines, _found) with _t, an array of (target, key)."""
    told = rows.withColumn("_all", _states(asked_texts(), F.transform("_t", lambda t: t["key"])))
    each = F.transform(F.arrays_zip(F.col("_t").alias("t"), F.col("_all").alias("s")), lambda e: F.struct(e["t"]["target"].alias("target"), F.array_join(kept_lines(e["s"], mode), "\n").alias("pruned")))
    # outer, as the filter that Spark derives from a plain one would work out every text twice
    out = told.select("path", "code", F.size("_lines").cast("long").alias("original_lines"), F.explode_outer(each).alias("_e")).where("_e is not null")
    out = out.select("path", "_e.target", "code", "original_lines", "_e.pruned")
    pair = tokens.estimate_pair(F.coalesce("code", F.lit("")), F.col("pruned"))
    filled = F.size(F.filter(text.split_lines(F.col("pruned")), lambda x: x.rlike(r"(?U)\S"))).cast("long")
    return out.select(
        *FILE, F.col("pruned").alias("code"), "original_lines", filled.alias("pruned_lines"),
        pair["original"].alias("original_tokens"), pair["pruned"].alias("pruned_tokens"), pair["saved"].alias("saved_tokens"),
    )
