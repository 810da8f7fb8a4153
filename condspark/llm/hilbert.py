"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``2^bits`` cells at its own quantiles, rows are sorted by their
cells' place on the curve, and the sorted run is cut into shards whose row counts differ by one
at most.  Neighbours on the curve are neighbours in every dimension, so a shard spans small
ranges of all of them and files can be skipped by any.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch

#: Of the quantiles: their buckets' number bounds what a task sends.
ACCURACY = 1000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of each row of cells (n x dimensions, values below 2^bits).

    The coordinates become the transposed index by undoing, from the highest bit down, the
    reflections and exchanges of axes that the curve makes in each quadrant (Skilling 2004).
    """
    x = np.array(cells, dtype=np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for d in range(dims):
            high = (x[d] >> b & 1).astype(bool)
            swap = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = out << 1 | x[d] >> b & 1
    return out


def _as_number(df: DataFrame, name: str) -> Column:
    """An order-preserving number; a null goes first."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.DateType)):
        value = F.unix_timestamp(F.col(name).cast("timestamp")).cast("double")
    else:
        value = F.col(name).cast("double")
    return F.coalesce(value, F.lit(float("-inf")))


def string_cuts(values: DataFrame, cells: int) -> list[str]:
    """At most cells - 1 strings that part a column's rows (one string column, without nulls) into cells of near equal counts.

    Whole strings count, in byte order.  Distinct strings are counted, sorted by ranges and numbered by sums of
    the ranges before, so only the cuts and a number a partition come to the driver.
    """
    spark, (name,) = values.sparkSession, values.columns
    counts = values.groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n"))
    ranges = counts.repartitionByRange(scratch.partitions(spark), "v").sortWithinPartitions("v")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column(1).to_numpy(zero_copy_only=False)
            upto = total + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(upto), pa.array(np.full(b.num_rows, part, np.int32))], ["v", "n", "upto", "part"])
            total = int(upto[-1]) if len(upto) else total

    ranked = scratch.table(ranges.mapInArrow(number, "v string, n long, upto long, part int"), "strings")
    sums = {r["part"]: r["t"] for r in ranked.groupBy("part").agg(F.max("upto").alias("t")).collect()}
    if not sums:
        return []
    before, base = {}, 0
    for part in sorted(sums):
        before[part], base = base, base + sums[part]
    at = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("part")] + F.col("upto")
    # the string in whose run a share of the rows ends is a cut
    crossed = F.floor(at * cells / F.lit(base)) > F.floor((at - F.col("n")) * cells / F.lit(base))
    return sorted((r["v"] for r in ranked.where(crossed & (at < base)).select("v").collect()), key=lambda v: v.encode())


RESERVED = {"curve", "shard", "slot", "_tie", "_part", "_place", "_before"}


def hilbert_shards(df: DataFrame, dims: Sequence[str], shards: int = 16, keep: Sequence[str] = (), tie: Sequence[str] = (), bits: int = 5) -> DataFrame:
    """(keep, curve, shard, slot): every row's shard and its gapless place in it.

    Cells part a dimension at its quantiles; strings count whole, in byte order, and nulls go first.
    Rows of one cell go in the order of a hash of ``tie``, then of ``tie`` itself, so a cell that holds
    much of the table is cut like any other run.  Repeated rows all get a place.  Only ``keep``,
    ``tie`` and ``dims`` are moved; an empty table gives no rows.  Very long strings are compared whole.  Kept and tie
    columns can't have the names that are given here (RESERVED): a ValueError.
    """
    if clash := RESERVED & {*keep, *tie}:
        raise ValueError(f"a column is named {sorted(clash)[0]}, as one that is added")
    spark = df.sparkSession
    n = 1 << bits
    strings = {d for d in dims if isinstance(df.schema[d].dataType, T.StringType)}
    numeric = [d for d in dict.fromkeys(dims) if d not in strings]
    shares = [(i + 1) / n for i in range(n - 1)]
    cuts = df.agg(*[F.percentile_approx(_as_number(df, d), shares, ACCURACY).alias(f"_cut{i}") for i, d in enumerate(numeric)]).first() if numeric else []
    edges = {d: [float(x) for x in c or []] for d, c in zip(numeric, cuts, strict=True)}
    edges |= {d: string_cuts(df.select(F.coalesce(d, F.lit("")).alias(d)), n) for d in strings}

    def cell(d: str) -> Column:
        value = F.coalesce(d, F.lit("")) if d in strings else _as_number(df, d)
        below = [(value > F.lit(e)).cast("int") for e in edges[d]]
        return functools.reduce(operator.add, below, F.lit(0))

    @F.pandas_udf("long")
    def curve(*columns: pd.Series) -> pd.Series:
        if not len(columns[0]):
            return pd.Series([], dtype="int64")
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], axis=1), bits))

    names = list(dict.fromkeys([*keep, *tie]))
    rows = df.select(*names, curve(*[cell(d) for d in dims]).alias("curve"), F.xxhash64(*[F.col(t) for t in tie]).alias("_tie") if tie else F.lit(0).cast("long").alias("_tie"))
    rows = scratch.table(rows, "curve")
    order = ["curve", "_tie", *tie]
    # numbered within ranges of the curve, then by sums of the ranges before: one number a partition
    ranges = rows.repartitionByRange(scratch.partitions(spark), *order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(n, n + b.num_rows))], [*b.schema.names, "_part", "_place"])
            n += b.num_rows

    ranked = scratch.table(ranges.mapInArrow(number, f"{ranges._jdf.schema().toDDL()}, _part int, _place long"), "ranked")
    counts = sorted((r["_part"], r["count"]) for r in ranked.groupBy("_part").count().collect())
    total = sum(n for _, n in counts)
    before, base = {}, 0
    for part, n in counts:
        before[part], base = base, base + n
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "_part int, _before long")
    place = F.col("_before") + F.col("_place")
    # shard s takes places from ceil(s * total / shards) on
    shard = F.expr(f"cast((_before + _place) * {shards} div {max(total, 1)} as int)")
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return ranked.join(F.broadcast(offsets), "_part").withColumn("shard", shard).withColumn("slot", place - first).select(*keep, "curve", "shard", "slot")


def write_shards(df: DataFrame, placed: DataFrame, key: Sequence[str], path: str) -> None:
    """Write df's rows as one folder a shard, in slot order; key must be unique in both, else a ValueError.

    A reader that filters by a dimension skips files by their statistics.
    """
    if placed.groupBy(*key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{', '.join(key)} is not unique")
    rows = df.join(placed.select(*key, "shard", "slot"), list(key))
    # ranges of places, so that a shard is several files by as many tasks
    rows.repartitionByRange(scratch.partitions(df.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
