"""Nearest neighbours by a forest of hash prefixes.

Each of ``TREES`` trees gives a vector a long hash string: ``SYMBOLS`` symbols, each the axis (with its sign) nearest to
the vector after a random rotation.  A tree is the sorted array of its strings.  A query descends in every tree to
the strings that share the longest prefix with its own, and then ascends in all trees at once, one symbol a step,
until enough strings share what is left of its prefixes; those vectors are its candidates, scored exactly.

Rows lie in blocks of ``BLOCK`` vectors, dealt evenly, and a block's forest is built where it is searched.  The
queries, in groups of ``GROUP``, meet every block and bring the best of each; a group of near copies that
holds a third of all rows is dealt over all blocks like any other.  The larger inner product is nearer: a block's vectors
get one more component that makes them equally long (a query's is 0), so angles order them alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch, wordhash

TREES, SYMBOLS, BITS = 48, 6, 10
BLOCK, GROUP = 8192, 2048
#: Strings to be met before a query stops ascending: at least so many, and so large a share of its block.
LEAST, SHARE = 2048, 0.2


def strings(vectors: np.ndarray, trees: int = TREES, symbols: int = SYMBOLS) -> np.ndarray:
    """Hash strings (trees x vectors), symbols packed into 64 bits with the first highest."""
    n, dim = vectors.shape
    x, out = vectors.astype(np.float32), np.zeros((trees, n), np.uint64)
    # the same for all blocks; of many axes each symbol looks at some
    rng, axes = np.random.default_rng(20_011), min(dim, 1 << BITS - 1)
    for t in range(trees):
        for _ in range(symbols):
            turn = np.linalg.qr(rng.standard_normal((dim, axes)))[0].astype(np.float32)
            y = x @ turn
            axis = np.abs(y).argmax(axis=1)
            symbol = axis * 2 + (y[np.arange(n), axis] > 0)
            out[t] = out[t] << np.uint64(BITS) | symbol.astype(np.uint64)
    return out


class Forest:
    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        long = np.sqrt((vectors**2).sum(axis=1))
        self.long = long.max(initial=0.0)
        rest = np.sqrt(np.maximum(self.long**2 - long**2, 0))
        keys = strings(np.column_stack([vectors, rest]))
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)

    def candidates(self, queries: np.ndarray, wanted: int) -> list[np.ndarray]:
        """Places of the vectors that each query meets."""
        own = strings(np.column_stack([queries, np.zeros(len(queries))]))
        n, trees = len(self.vectors), range(len(self.keys))
        low, high = np.zeros((len(self.keys), len(queries)), np.int64), np.zeros((len(self.keys), len(queries)), np.int64)
        open_ = np.arange(len(queries))
        # all trees at once, from whole strings upwards; most queries are done after few steps
        for depth in range(SYMBOLS, 0, -1):
            shift = np.uint64(BITS * (SYMBOLS - depth))
            for t in trees:
                prefix = own[t, open_] >> shift << shift
                low[t, open_] = np.searchsorted(self.keys[t], prefix, "left")
                high[t, open_] = np.searchsorted(self.keys[t], prefix | (np.uint64(1) << shift) - np.uint64(1), "right")
            open_ = open_[(high - low)[:, open_].sum(axis=0) < wanted]
            if not len(open_):
                break
        low[:, open_], high[:, open_] = 0, 0
        high[0, open_] = n  # the root: every vector once
        out, met = [], np.zeros(n, bool)
        for i in range(len(queries)):
            for t in trees:
                met[self.order[t, low[t, i] : high[t, i]]] = True
            out.append(np.flatnonzero(met))
            met[:] = False
        return out


def nearest(forest: Forest, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of the k nearest that each query meets, but for the row that it is itself."""
    wanted = max(LEAST, int(SHARE * len(rows)))
    out = []
    for q, row, at in zip(queries, own, forest.candidates(queries, wanted), strict=True):
        at = at[rows[at] != row]
        rough = forest.vectors[at] @ q
        if len(at) > k:
            edge = np.partition(rough, len(at) - k)[len(at) - k]
            near = rough >= edge - 1e-9 * max(1.0, forest.long * float(np.sqrt(q @ q)))
            at = at[near]
        # component after component, so that equal vectors score alike wherever they lie
        score = np.cumsum(forest.vectors[at] * q, axis=1)[:, -1] if len(at) else np.zeros(0)
        first = np.lexsort((ids[at], -score))[:k]
        out.append((ids[at[first]], score[first]))
    return out


def _packed(rows: DataFrame, size: int, total: int, name: str) -> DataFrame:
    """(number, dim, ids, rows, vectors) with about ``size`` rows each, vectors of one dimension together."""

    def pack(batches):
        held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not held:
            return
        own = pa.concat_tables(held)
        lengths = own.column("vec").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths):
            part = own.filter(pa.array(lengths == dim))
            flat = part.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8")
            yield pa.RecordBatch.from_arrays([
                part.column("part").combine_chunks()[:1], pa.array([int(dim)], pa.int32()), pa.array([part.column("id").to_numpy().astype("<i8").tobytes()]),
                pa.array([part.column("row").to_numpy().astype("<i8").tobytes()]), pa.array([flat.tobytes()]),
            ], ["number", "dim", "ids", "rows", "vectors"])

    dealt = rows.repartition(max(1, -(-total // size))).select("id", "row", "vec", F.spark_partition_id().alias("part"))
    return scratch.table(dealt.mapInArrow(wordhash.tidy(pack), "number int, dim int, ids binary, rows binary, vectors binary"), name)


def _array(table: pa.Table, name: str, i: int, kind: str) -> np.ndarray:
    return np.frombuffer(table.column(name)[i].as_py(), kind)


def neighbours(table: DataFrame, asked: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score): the k rows found nearest to each row where ``asked`` holds, nearest first.

    score is the inner product in double precision; ties go to the smaller id.  Rows with a null id, and vectors that are
    null, empty, zero or hold a null or a number that isn't finite take no part.  Vectors of different lengths don't
    meet.  A row isn't its own neighbour, a row that repeats it is, and asks for itself.  Where fewer than k rows are there, all are
    returned.  Nothing is asked of an empty table.  Blocks of no more than LEAST rows are searched whole.  Other columns
    are ignored.
    """
    spark = table.sparkSession
    vec = F.col(f"`{vector_col}`").cast("array<double>")
    sound = F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(vec, lambda x: x != 0)
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("vec"), F.coalesce(asked, F.lit(False)).alias("asked"), F.coalesce(sound, F.lit(False)).alias("sound"))
    rows = scratch.table(rows.where("sound and id is not null").select("id", "vec", "asked", F.monotonically_increasing_id().alias("row")), "vectors")
    total = rows.agg(F.count("*").alias("n"), F.count_if("asked").alias("m")).first()
    blocks = _packed(rows.drop("asked"), BLOCK, total["n"], "blocks")
    groups = _packed(rows.where("asked").drop("asked"), GROUP, total["m"], "groups")
    n_blocks, n_groups = -(-total["n"] // BLOCK), -(-total["m"] // GROUP)
    # a stated query set against all rows, in blocks: every group meets every block once
    cell = lambda other, n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias(other)
    left = blocks.select(F.col("number").alias("block"), "dim", "ids", "rows", "vectors", cell("group", n_groups))
    right = groups.select(F.col("number").alias("group"), "dim", "ids", "rows", "vectors", cell("block", n_blocks))

    def search(block: pa.Table, group: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_row": [], "query_id": [], "id": [], "score": []}
        for i in range(block.num_rows if group.num_rows else 0):
            dim = block.column("dim")[i].as_py()
            ids, own = _array(block, "ids", i, "<i8"), _array(block, "rows", i, "<i8")
            forest = Forest(_array(block, "vectors", i, "<f8").reshape(-1, dim))
            for j in range(group.num_rows):
                if group.column("dim")[j].as_py() != dim:
                    continue
                who, q_ids = _array(group, "rows", j, "<i8"), _array(group, "ids", j, "<i8")
                queries = _array(group, "vectors", j, "<f8").reshape(-1, dim)
                for row, q, (near, score) in zip(who.tolist(), q_ids.tolist(), nearest(forest, ids, own, queries, who, k), strict=True):
                    found["query_row"].append(np.full(len(near), row))
                    found["query_id"].append(np.full(len(near), q))
                    found["id"].append(near)
                    found["score"].append(score)
        kinds = {"score": np.float64}
        return pa.table({c: pa.array(np.concatenate([*v, np.zeros(0, kinds.get(c, np.int64))])) for c, v in found.items()})

    met = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(wordhash.tidied(search), "query_row long, query_id long, id long, score double")
    best = W.partitionBy("query_row").orderBy(F.desc("score"), F.asc("id"))
    ranked = scratch.table(met, "met").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
