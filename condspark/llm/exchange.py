"""Questions from blocks of documents to a sharded table of hashes, and the answers back.

Corpus-wide counts of word n-grams need every n-gram to meet its equals.  Sending one row
for each occurrence moves several times the text and piles hot keys on one task.  Here the
documents are first written as blocks of about ``BLOCK`` bytes, bucketed by block.  A block
asks about its *distinct* hashes only (the combine before the shuffle), so a key that a
third of the corpus holds comes at most once from each block.  Hashes are cut into shards by
range; one row carries all of a block's sorted hashes for a shard, packed as differences.
A shard answers each block in the order of its question, and a grouping of blocks with answers
by block moves the answers alone, as the blocks are bucketed already.

Nothing is broadcast or collected but sums of fixed size.  A lost executor's tasks rerun from
the written tables.  One shard holds about 1 / shuffle partitions of all distinct hashes and
one block is bounded by its bytes (or one longer text).
"""

from __future__ import annotations

import ast
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, wordhash

BLOCK = 6_000_000


def write_blocks(docs: DataFrame, id_col: str | None, text_col: str, more: dict[str, Column] | None = None, bytes_a_block: int = BLOCK) -> DataFrame:
    """(block long, place long, id, text, ``more``) with every row of docs, bucketed by block.

    place counts a block's rows from 0.  A null text stays null.  With None for ``id_col`` there is no id.
    """
    own = [] if id_col is None else [F.col(id_col).alias("id")]
    rows = docs.select(*own, F.col(text_col).cast("string").alias("text"), *(c.alias(k) for k, c in (more or {}).items()))
    names, at = rows.columns, len(own)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, rows_held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            text = batch.column(at)
            size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(text), 0)).astype(np.int64)
            number, place = np.empty(len(size), dtype=np.int64), np.empty(len(size), dtype=np.int64)
            begin = 0
            while begin < len(size):
                fits = int(np.searchsorted(np.cumsum(size[begin:]), bytes_a_block - held, "right"))
                if not fits and not held:
                    fits = 1
                number[begin : begin + fits] = block
                place[begin : begin + fits] = np.arange(rows_held, rows_held + fits)
                rows_held += fits
                held += int(size[begin : begin + fits].sum())
                begin += fits
                if begin < len(size):
                    block, held, rows_held = block + 1, 0, 0
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(place), *batch.columns], ["block", "place", *names])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return scratch.table(rows.mapInArrow(deal, f"block long, place long, {schema}"), "blocks", "block")


def _planes(values: np.ndarray) -> bytes:
    """Byte planes of an array, each compressed alone, as their entropies differ widely."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    press = zstandard.ZstdCompressor(level=1)
    parts = [press.compress(p.tobytes()) for p in planes]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _whole(blob: bytes, at: int, kind: np.dtype, n: int) -> tuple[np.ndarray, int]:
    """The array of n values whose planes begin at a place, and the place after them."""
    out, press = np.empty((n, kind.itemsize), np.uint8), zstandard.ZstdDecompressor()
    for k in range(kind.itemsize):
        size = int.from_bytes(blob[at : at + 4], "little")
        out[:, k] = np.frombuffer(press.decompress(blob[at + 4 : at + 4 + size]), np.uint8)
        at += 4 + size
    return out.view(kind).reshape(n), at


def pack(sorted_hashes: np.ndarray) -> bytes:
    return len(sorted_hashes).to_bytes(8, "little") + _planes(np.diff(sorted_hashes, prepend=np.uint64(0)).astype("<u8"))


def unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(_whole(blob, 8, np.dtype("<u8"), int.from_bytes(blob[:8], "little"))[0], dtype=np.uint64)


FEW = 1024


def squeeze(values: np.ndarray) -> bytes:
    """Any array, field by field, as compressed byte planes; floats of few values as places in a list.

    Plain integers, which can be few, go in one frame.
    """
    if values.dtype.kind in "iu":
        planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
        return f"{values.dtype.str!r}#".encode() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())
    head, body = [], b""
    for name in values.dtype.names or ("",):
        v = np.ascontiguousarray(values[name] if name else values)
        listed = v[:0]
        if v.dtype.kind == "f" and len(v) and len(np.unique(v[: 2 * FEW])) <= min(FEW, len(v) // 2):
            listed, places = np.unique(v, return_inverse=True)
            listed, v = (listed, places.astype("<u2")) if len(listed) <= 1 << 16 else (listed[:0], v)
        head.append((name, values.dtype[name].str if name else values.dtype.str, v.dtype.str, len(listed)))
        body += _planes(listed) + _planes(v) if len(listed) else _planes(v)
    return f"{(len(values), head)!r}#".encode() + body


def expand(blob: bytes) -> np.ndarray:
    end = blob.index(b"#")
    head = ast.literal_eval(blob[:end].decode())
    if isinstance(head, str):
        kind = np.dtype(head)
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[end + 1 :]), np.uint8).reshape(kind.itemsize, -1)
        return np.ascontiguousarray(planes.T).view(kind).ravel()
    n, fields = head
    at, found = end + 1, []
    for _, kind, stored, listed in fields:
        if listed:
            values, at = _whole(blob, at, np.dtype(kind), listed)
        v, at = _whole(blob, at, np.dtype(stored), n)
        found.append(values[v] if listed else v)
    if not fields[0][0]:
        return found[0]
    out = np.empty(n, [(name, kind) for name, kind, _, _ in fields])
    for (name, *_), v in zip(fields, found, strict=True):
        out[name] = v
    return out


QUESTION = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("data", pa.binary())])
ANSWER = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("data", pa.binary())])
QUESTION_SQL = "shard int, kind int, block long, keys binary, data binary"
ANSWER_SQL = "block long, kind int, shard int, data binary"


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def questions(block: int, kind: int, keys: np.ndarray, data: np.ndarray, shards: int, of: np.ndarray | None = None) -> list[dict]:
    """One row for each shard that sorted distinct ``keys`` touch; ``data`` goes along, one value a key.

    ``of``: the ascending shards of keys that name them not themselves, and that are sorted within a shard.
    """
    of = shard_of(keys, shards) if of is None else of
    cuts = np.searchsorted(of, np.arange(shards + 1))
    return [
        {"shard": s, "kind": kind, "block": block, "keys": pack(keys[a:b]), "data": squeeze(data[a:b])}
        for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
        if b > a
    ]


def ask(blocks: DataFrame, answers: DataFrame | None, fn: Callable[[int, pa.Table, dict[int, np.ndarray]], list[dict]]) -> DataFrame:
    """Questions of every block: fn(block, its rows, answers so far by kind)."""

    def made(block: int, rows: pa.Table, have: dict[int, np.ndarray]) -> pa.Table:
        return pa.Table.from_pylist(fn(block, rows, have), QUESTION)

    return each_block(blocks, answers, made, QUESTION_SQL)


def each_block(blocks: DataFrame, answers: DataFrame | None, fn: Callable[[int, pa.Table, dict[int, np.ndarray]], pa.Table], schema: str) -> DataFrame:
    if answers is None:
        return blocks.groupBy("block").applyInArrow(wordhash.tidied(lambda rows: fn(rows.column("block")[0].as_py(), in_order(rows), {})), schema)

    def both(key, rows: pa.Table, replies: pa.Table) -> pa.Table:
        return fn(key[0].as_py(), in_order(rows), gather(replies))

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(wordhash.tidied(both), schema)


def in_order(rows: pa.Table) -> pa.Table:
    """Sorted by place: a block's rows come grouped, but in no sure order."""
    return rows.sort_by("place").combine_chunks() if "place" in rows.column_names else rows


def gather(replies: pa.Table) -> dict[int, np.ndarray]:
    parts: dict[int, list[tuple[int, bytes]]] = {}
    for kind, shard, data in zip(*(replies.column(c).to_pylist() for c in ("kind", "shard", "data")), strict=True):
        parts.setdefault(kind, []).append((shard, data))
    return {kind: np.concatenate([expand(d) for _, d in sorted(own, key=lambda x: x[0])]) for kind, own in parts.items()}


def replies(asked: DataFrame, fn: Callable[[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], keep: Callable[..., list[tuple[int, bytes]]] | None = None) -> DataFrame:
    """Answers by block.

    fn(kind, keys, data, block order, inverse) sees all of one shard's questions of one kind:
    distinct keys, then for every asked key its data, the rank of its block and its place among the
    distinct keys; it returns a value for every asked key.  ``keep`` gets the same and may return rows
    (of kind, data) that come beside the answers under block -1.
    """

    def shard(rows: pa.Table) -> pa.Table:
        kind, number = rows.column("kind")[0].as_py(), rows.column("shard")[0].as_py()
        rows = rows.sort_by("block")
        blocks = rows.column("block").to_pylist()
        keys = [unpack(x) for x in rows.column("keys").to_pylist()]
        data = np.concatenate([expand(x) for x in rows.column("data").to_pylist()])
        cuts = np.cumsum([0, *map(len, keys)])
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        rank = np.repeat(np.arange(len(blocks)), np.diff(cuts))
        out = fn(kind, distinct, data, rank, inverse)
        told = [{"block": b, "kind": kind, "shard": number, "data": squeeze(out[x:y])} for b, x, y in zip(blocks, cuts[:-1], cuts[1:], strict=True)]
        if keep:
            told += [{"block": -1, "kind": k, "shard": number, "data": d} for k, d in keep(kind, distinct, data, rank, inverse)]
        return pa.Table.from_pylist(told, ANSWER)

    return asked.groupBy("shard", "kind").applyInArrow(wordhash.tidied(shard), ANSWER_SQL)


def answer(asked: DataFrame, fn: Callable[..., np.ndarray]) -> DataFrame:
    """Answers by block, written to a shared table."""
    return scratch.table(replies(asked, fn), "answers")


def by_block(answers: DataFrame) -> DataFrame:
    """The answers dealt like the blocks, so that both meet without moving again."""
    return answers.repartition(scratch.partitions(answers.sparkSession), "block")


def answer_and_keep(asked: DataFrame, fn: Callable[..., np.ndarray], keep: Callable[..., list[tuple[int, bytes]]]) -> list[DataFrame]:
    """Answers and what ``keep`` returned, each as a shared table."""
    return scratch.parts(replies(asked, fn, keep).withColumn("kept", F.col("block") < 0), "kept", [False, True])


def merged(old: list[DataFrame], new: list[DataFrame]) -> DataFrame:
    """The answers of written tables, which go, and others, in one table bucketed like the blocks."""
    every = [*old, *new]
    whole = scratch.table(by_block(functools.reduce(DataFrame.unionByName, every)), "answers", "block")
    for x in old:
        scratch.drop(x)
    return whole
