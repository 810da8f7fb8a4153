"""Best-fit packing, certified by dual-feasible-function lower bounds.

Documents are cut into pieces of at most ``capacity`` tokens.  Full pieces are sequences as they
are.  The others are dealt to groups of bounded size and each group is packed by best-fit
decreasing.  Dual feasible functions bound from below how many sequences a group needs; a
group that meets its bound is certified.  Sequences with free space then give their pieces
back, the emptiest first: any of them where a group has a gap, those with more than ``SLACK`` tokens free where
it is certified, but no more than a ``FEWER``-th of a full group's pieces.  The pieces given back are dealt
anew to a ``FEWER``-th of the groups and packed again, until one group packs all that is left or the total meets
the bound of the whole corpus, which needs only the histogram of lengths.  So a group stays bounded and rounds
grow with the logarithm of the corpus, also where a gap is the bound's and can't be closed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, scratch, wordhash

GROUP = 60_000
SLACK = 32
FEWER = 4
RESERVED = {"row", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "group", "open", "text"}
#: Dual feasible functions of 2 to STEPS + 1 steps are tried.
STEPS = 16


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Most of the bounds by dual feasible functions, over every threshold."""
    return bound_of(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of(count: np.ndarray, capacity: int) -> int:
    """The same from a histogram: count[w] pieces of length w.

    The functions are those that raise pieces of which none smaller than a threshold fits beside, and drop those
    (Martello and Toth), alone, with the room left counted, and followed by rounding in k steps (Fekete and Schepers): of
    k + 1 equal parts a piece that doesn't end on one loses what is over, and each full part counts 1 / k.
    """
    count = np.asarray(count, np.int64)
    weight = count * np.arange(capacity + 1)
    n, w = np.cumsum(count), np.cumsum(weight)
    best = -(-int(w[-1]) // capacity)
    half = capacity // 2
    for a in range(0, half + 1):
        # longer than capacity - a: one each; up to those longer than half: one each, with room left; from a on: fill that room
        huge = n[-1] - n[capacity - a]
        big, big_w = n[capacity - a] - n[half], w[capacity - a] - w[half]
        small = w[half] - (w[a - 1] if a else 0)
        best = max(best, int(huge + big + max(0, -(-(small - (big * capacity - big_w)) // capacity))))
    lengths, a = np.arange(capacity + 1), np.arange(half + 1)
    for k in range(1, STEPS + 1):
        parts = (k + 1) * lengths
        step = np.where(parts % capacity == 0, k * lengths, capacity * (parts // capacity))
        upto = np.concatenate([[0], np.cumsum(count * step)])
        value = upto[capacity - a + 1] - upto[a] + k * capacity * (n[-1] - n[capacity - a])
        best = max(best, -(-int(value.max()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece and the free space of every sequence."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_sizes, free = 0, []
    for i in order.tolist():
        w = int(lengths[i])
        fits = free_sizes >> w
        if fits:
            r = (fits & -fits).bit_length() - 1 + w
            b = open_bins[r].pop()
            if not open_bins[r]:
                free_sizes ^= 1 << r
        else:
            b, r = len(free), capacity
            free.append(capacity)
        where[i], offset[i] = b, capacity - r
        free[b] = left = r - w
        if left:
            open_bins[left].append(b)
            free_sizes |= 1 << left
    return where, offset, np.asarray(free, np.int64)


def given_back(where: np.ndarray, free: np.ndarray, gap: bool, groups: int, most: int) -> np.ndarray:
    """Which sequences of one of several groups give their pieces back, the emptiest first and ``most`` pieces at most."""
    opened = np.zeros(len(free), bool)
    if groups > 1:
        order = np.argsort(-free, kind="stable")
        order = order[free[order] > (0 if gap else SLACK)]
        opened[order[np.cumsum(np.bincount(where, minlength=len(free))[order]) <= most]] = True
    return opened


def token_pieces(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int, id_col: str, text_col: str, keep_space: bool) -> DataFrame:
    """(row, id_col, piece, start, length, ids_crc32), written to a shared table; row is unique."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, row = bpe.encoder(tokenizer_file, keep_space), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, texts in bpe.steps(batch.column(1), 4_000_000):
                ids, cuts = e.encode(texts)
                doc, piece, start, length, crc = [], [], [], [], []
                for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    for k, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        doc.append(at + i)
                        piece.append(k)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                rows = np.arange(row, row + len(doc))
                row += len(doc)
                yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["row", id_col, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    return scratch.table(rows.mapInArrow(wordhash.tidy(cut), f"row long, `{id_col}` {kind}, piece int, start long, length long, ids_crc32 long"), "pieces")


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_space: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns (id_col, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece.  A
    null text is empty: its one piece is the end id.  Only documents longer than ``capacity`` are cut.
    Repeated rows are packed one by one; an empty table gives no rows.  Other columns are ignored; the id column can't have
    the name of one that is made on the way (RESERVED): a ValueError.
    """
    if id_col in RESERVED:
        raise ValueError(f"the id column is named {id_col}, as one that is added")
    spark = docs.sparkSession
    pieces = token_pieces(docs, tokenizer_file, end_id, capacity, id_col, text_col, keep_space)
    full = pieces.where(F.col("length") == capacity).select("*", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = pieces.where(F.col("length") < capacity)
    closed, base, number, groups = [full], 1 << 62, 0, None
    histogram = np.zeros(capacity + 1, np.int64)
    for r in left.groupBy("length").count().collect():
        histogram[r["length"]] = r["count"]
    bound, done, n = bound_of(histogram, capacity), 0, int(histogram.sum())
    schema = f"{left._jdf.schema().toDDL()}, sequence_id long, offset long, open boolean"
    while n:
        fewer = -(-n // GROUP)
        groups, most = fewer if groups is None else min(fewer, max(1, groups // FEWER)), max(1, GROUP // FEWER)

        def packed(rows: pa.Table) -> pa.Table:  # runs before base and groups change
            rows = rows.sort_by("row")
            group = rows.column("group")[0].as_py()
            rows = rows.drop_columns(["group"])
            lengths = rows.column("length").to_numpy()
            where, offset, free = best_fit_decreasing(lengths, capacity)
            gap = len(free) > lower_bound(lengths, capacity)
            opened = given_back(where, free, gap, groups, most)
            return rows.append_column("sequence_id", pa.array(base + (group << 20) + where)).append_column("offset", pa.array(offset)).append_column("open", pa.array(opened[where]))

        dealt = left.withColumn("group", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(groups)).cast("int"))
        got = scratch.table(dealt.groupBy("group").applyInArrow(packed, schema), "packed")
        stats = got.groupBy("open").agg(F.count("*").alias("n"), F.countDistinct("sequence_id").alias("bins")).collect()
        n = sum(r["n"] for r in stats if r["open"])
        done += sum(r["bins"] for r in stats if not r["open"])
        if done + sum(r["bins"] for r in stats if r["open"]) <= bound:
            closed.append(got.drop("open"))
            break
        closed.append(got.where("not open").drop("open"))
        left = got.where("open").drop("open", "sequence_id", "offset")
        base, number = base + (groups << 20), number + 1
    out = closed[0]
    for df in closed[1:]:
        out = out.unionByName(df)
    return out.drop("row")
