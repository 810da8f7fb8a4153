"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code.

Ids are replaced by their rank in the corpus (most frequent first, ties by id), so most fit one
byte.  A rank takes 1 to 4 bytes; its length less one is a 2-bit code in a separate stream of
control bytes, four to a byte, low bits first.  A reader looks up the four lengths of a control
byte in a table and gathers all values at once with numpy.

A file is a folder: ``ranks`` holds (rank, id); ``segments`` holds rows of about ``SEGMENT`` ids:
(part, seq, first_token within the part, n_tokens, doc_ids, doc_lengths, control, data), the
last three being binary.  Parts are ascending ranges of document ids, segments ascend in them.
The container is Parquet, so any store that Spark writes to will do and a failed task's output
is never seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, scratch, wordhash

SEGMENT = 1 << 19
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned values below 2^32."""
    v = values.astype(np.uint32)
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = np.append(code, np.zeros(-len(code) % 4, np.uint8)).reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    size = code.astype(np.int64) + 1
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    data[at] = v & 0xFF
    for k in (1, 2, 3):
        on = np.flatnonzero(code >= k)
        data[at[on] + k] = v[on] >> (8 * k) & 0xFF
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        on = np.flatnonzero(size > k)
        out[on] |= raw[at[on] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ends of the cells, from 0 on, and their bytes) of a binary column."""
    _, edges, data = column.buffers()
    edges = np.frombuffer(edges, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
    return edges - edges[0], raw


def _steps(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The cells in runs of about bpe's step, with the place of each run."""
    edges, _ = _cells(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + wordhash.STEP, "right")) - 1)
        yield a, column.slice(a, b - a)
        a = b


def encoded(docs: DataFrame, id_col: str, text_col: str, tokenizer_file: str, keep_space: bool, end_id: int) -> DataFrame:
    """(id, tie, ids, counts), written: a row for each text with its ids packed, and one for each partition with the counts of ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = bpe.encoder(tokenizer_file, keep_space)
        total = np.zeros(max(e.size, end_id + 1), np.int64)
        kind, names, of = "<u2" if len(total) <= 1 << 16 else "<u4", ["id", "tie", "ids", "counts"], pa.null()
        for batch in batches:
            of = batch.schema.field(0).type
            for at, texts in bpe.steps(batch.column(2)):
                ids, cuts = e.encode(texts)
                total += np.bincount(ids, minlength=len(total))
                total[end_id] += len(texts)
                packed = pa.py_buffer(ids.astype(kind))
                edges = pa.py_buffer((cuts * int(kind[-1])).astype(np.int32))
                blobs = pa.Array.from_buffers(pa.binary(), len(texts), [None, edges, packed])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), blobs, pa.nulls(len(texts), pa.binary())], names)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, of), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()])], names)

    text = F.col(text_col).cast("string")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    return scratch.table(rows.mapInArrow(encode, f"id {kind}, tie long, ids binary, counts binary"), "encoded")


def id_ranks(rows: DataFrame) -> list[tuple[int, int]]:
    """(id, count) of every id in encoded rows, most frequent first: at most as many as the vocabulary has."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                total = np.frombuffer(blob.as_py(), "<i8")
                on = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(total[on])], ["id", "n"])

    counts = rows.where("counts is not null").select("counts").mapInArrow(tell, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return sorted(((r["id"], r["n"]) for r in counts.collect()), key=lambda r: (-r[1], r[0]))


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", keep_space: bool = True) -> str:
    """Encode every text, add end_id, write all in ascending id_col order (nulls first) and return path.

    A null text is empty and becomes the end id alone.  Rows with equal ids go in the order of
    their texts' hashes; an empty table gives a file without segments.  Texts are tokenised once; their packed ids are what is
    sorted.  A very long text's ids are packed in one cell and cut into segments of their own; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = encoded(docs, id_col, text_col, tokenizer_file, keep_space, end_id)
    ranked = id_ranks(rows)
    spark.createDataFrame([(r, i, n) for r, (i, n) in enumerate(ranked)], "rank int, id int, n long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max((i for i, _ in ranked), default=0) + 1, np.uint32)
    rank_of[[i for i, _ in ranked]] = np.arange(len(ranked))
    narrow = max(bpe.encoder(tokenizer_file, keep_space).size, end_id + 1) <= 1 << 16
    end_rank = rank_of[end_id] if ranked else 0

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        held, lengths, ids, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            ends = np.concatenate(lengths)
            control, data = encode_values(np.concatenate(held))
            cells = {"part": part, "seq": seq, "first_token": before, "n_tokens": size, "doc_lengths": ends.astype("<u4").tobytes(), "control": control, "data": data}
            arrays = [pa.array([v]) for v in cells.values()]
            arrays[:2] = [x.cast(pa.int32()) for x in arrays[:2]]
            every = pa.concat_arrays(ids)
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every))
            return pa.RecordBatch.from_arrays(arrays, [*cells, "doc_ids"])

        for batch in batches:
            for at, blobs in _steps(batch.column(1)):
                offsets, raw = _cells(blobs)
                got = raw.view("<u2" if narrow else "<u4")
                n = np.diff(offsets) // got.dtype.itemsize + 1
                out = np.full(int(n.sum()), end_rank, np.uint32)
                inside = np.ones(len(out), bool)
                inside[np.cumsum(n) - 1] = False
                out[inside] = rank_of[got]
                edge = np.concatenate([[0], np.cumsum(n)])
                a = 0
                while a < len(n):
                    b = max(a + 1, int(np.searchsorted(edge, edge[a] + SEGMENT - size, "right")) - 1) if size < SEGMENT else a
                    if b > a:
                        held.append(out[edge[a] : edge[b]])
                        lengths.append(n[a:b])
                        ids.append(batch.column(0).slice(at + a, b - a))
                        size += int(edge[b] - edge[a])
                        a = b
                    if size >= SEGMENT or a < len(n):
                        yield flush()
                        seq, before = seq + 1, before + size
                        held, lengths, ids, size = [], [], [], 0
        if held:
            yield flush()

    kind = docs.schema[id_col].dataType.simpleString()
    keep = rows.where("ids is not null").select("id", "ids", "tie")
    ordered = keep.repartitionByRange(scratch.partitions(spark), "id", "tie").sortWithinPartitions("id", "tie").select("id", "ids")
    schema = f"part int, seq int, first_token long, n_tokens long, doc_lengths binary, control binary, data binary, doc_ids array<{kind}>"
    ordered.mapInArrow(segments, schema).write.option("compression", "zstd").parquet(f"{path}/segments")
    return path


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids) of every document: ids are little-endian unsigned 32-bit integers."""
    ranked = spark.read.parquet(f"{path}/ranks").select("rank", "id").collect()
    id_of = np.array([i for _, i in sorted((r["rank"], r["id"]) for r in ranked)], dtype="<u4")
    rows = spark.read.parquet(f"{path}/segments")
    # one sum for each part: as many as the writer had partitions
    sums = dict((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    start, total = {}, 0
    for part in sorted(sums):
        start[part], total = total, total + sums[part]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {k: batch.column(k)[i].as_py() for k in ("part", "first_token", "n_tokens", "doc_lengths", "control", "data")}
                ids = id_of[decode_values(r["control"], r["data"], r["n_tokens"])]
                n = np.frombuffer(r["doc_lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(n)
                blob = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, pa.array(start[r["part"]] + r["first_token"] + ends - n), pa.array(n), blob], [id_col, "start", "n_tokens", "ids"])

    kind = rows.schema["doc_ids"].dataType.elementType.simpleString()
    return rows.mapInArrow(decode, f"`{id_col}` {kind}, start long, n_tokens long, ids binary")
