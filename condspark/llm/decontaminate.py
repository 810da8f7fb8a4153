"""Benchmark decontamination: rare n-gram seeds joined to passages, then Smith-Waterman alignment.

An alignment scores 1 for a word matched and -1 for a word that differs or is left out.  Between two runs of matched
words stands at least one such, so of m words matched in r runs it scores m - (r - 1) at most, and m - r =
score - 1 or more of its pairs of neighbouring words are intact in both texts.  An item whose leaks score S has
n - 1 pairs, S - 1 of which at least are in the passage; among any n - S + 1 of them there is one.  So the pairs are
counted over the corpus and each item's n - S + 1 rarest are its seeds: no passage that scores enough is without one,
words put in, left out or changed wherever they be, and the common pairs are never looked for.

Seeds are a table.  Each document's pairs pass a bit map of the seeds, of bounded size, and are joined with the table;
what it takes for seeds and aren't goes in the join.  A passage met must hold S - 1 of all the item's pairs, and
what is left is aligned with the item word by word.  Documents lie in blocks; pairs, candidates and
results move, texts don't.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import exchange, scratch, wordhash

#: Words of a seed, and words below which an item is no evidence.
SEED, LEAST = 2, 3
MIN_SCORE = 0.5
#: An alignment of this score is a leak whatever the item's length.
LEAK_WORDS = 20
#: Bits of the map of seeds: 16 for each, within these powers of 2.
BITS = 16, 27
#: Characters of scripts without spaces between words: each is a word.
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first of each text) of lower-cased words parted by anything but letters and digits.

    In scripts without spaces every character is a word.
    """
    low = pc.utf8_lower(column)
    offsets, raw = wordhash.string_buffers(low)
    if len(column) and (raw[offsets[0] : offsets[-1]] >= 0xE0).any():  # such characters have three bytes or more
        low = pc.replace_substring_regex(low, _UNSPACED, r" \1 ")
    h, _, _, first, _ = wordhash.words(low, gaps=wordhash.PLAIN)
    return h, first


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of words a with b: match +1, mismatch -1, gap -1.

    Returns (score, begin, end) with b[begin:end] the part of b aligned.
    """
    n = len(b)
    steps = np.arange(n + 1)
    row, origin = np.zeros(n + 1, np.int64), steps.copy()
    best = (0, 0, 0)
    for w in a:
        same = np.where(b == w, 1, -1)
        up, diag = row - 1, row[:-1] + same
        here, came = np.maximum(up, 0), np.where(up > 0, origin, steps)
        better = diag > here[1:]
        here[1:] = np.where(better, diag, here[1:])
        came[1:] = np.where(better, origin[:-1], came[1:])
        # gaps in a: the best value to the left less its distance
        lift = here + steps
        top = np.maximum.accumulate(lift)
        at = np.maximum.accumulate(np.where(lift == top, steps, 0))
        from_left = top - steps
        gap = from_left > here
        came = np.where(gap, came[at], came)
        row, origin = np.where(gap, from_left, here), came
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), int(origin[j]), j)
    return best


def needed(n: int, min_score: float) -> int:
    """The score from which a passage is a leak of an item of n words."""
    return max(2, math.ceil(min(min_score * n, LEAK_WORDS) - 1e-9))


def _pairs(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the words from each place on, the place) of the pairs that lie within one text."""
    g = wordhash.windows(h, SEED)
    end = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(len(g)) + SEED <= end[: len(g)])
    return g[at], at


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, key, words), written: the items of LEAST words or more, numbered, with their words' hashes."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            h, first = word_hashes(batch.column(1))
            on = np.flatnonzero(np.diff(first) >= LEAST)
            blobs = [h[first[i] : first[i + 1]].astype("<u8").tobytes() for i in on]
            yield pa.RecordBatch.from_arrays([pa.array(base + on), batch.column(0).take(pa.array(on)), pa.array(blobs, pa.binary())], ["item", "key", "words"])
            base += batch.num_rows

    kind = benchmark.schema[item_col].dataType.simpleString()
    rows = benchmark.select(F.col(f"`{item_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    return scratch.table(rows.mapInArrow(told, f"item long, key {kind}, words binary"), "items")


def _seeds(items: DataFrame, min_score: float) -> DataFrame:
    """(item, place, gram, enough): all pairs of the items, and how many of an item's pairs are sure to hold one that leaked."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.frombuffer(blob, "<u8")
                g, at = _pairs(h, np.array([0, len(h)]))
                enough = len(h) - needed(len(h), min_score) + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), item)), pa.array(at.astype(np.int32)), pa.array(g.view(np.int64)), pa.array(np.full(len(g), enough, np.int32))], ["item", "place", "gram", "enough"])

    return items.select("item", "words").mapInArrow(told, "item long, place int, gram long, enough int")


class _Map:
    """A bit map of a table's grams: those of the table pass, and few others."""

    def __init__(self, grams: DataFrame, n: int):
        self.bits = min(max(BITS[0], (16 * n).bit_length()), BITS[1])
        slot = F.shiftrightunsigned("gram", 64 - self.bits)
        cells = grams.select(slot.alias("s")).groupBy(F.expr("s div 64").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("v"))
        # as many rows as the map has cells, at most 2 ** (BITS[1] - 6)
        rows = cells.toArrow()
        self.cells = np.zeros(1 << self.bits - 6, np.uint64)
        self.cells[rows.column("cell").to_numpy()] = rows.column("v").to_numpy().view(np.uint64)

    def passes(self, g: np.ndarray) -> np.ndarray:
        slot = g >> np.uint64(64 - self.bits)
        return np.flatnonzero(self.cells[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))


def _rarest(blocks: DataFrame, seeds: DataFrame) -> DataFrame:
    """(gram, item), written: of each item as many pairs as are enough, those that the corpus holds most rarely."""
    known = _Map(seeds, seeds.count())

    def count(block: int, rows: pa.Table, _: dict) -> pa.Table:
        found = []
        for _, part in wordhash.steps(rows.column("text")):
            g, _ = _pairs(*word_hashes(part))
            found.append(g[known.passes(g)])
        keys, n = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
        return pa.table({"gram": pa.array(keys.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    counts = exchange.each_block(blocks, None, count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    ranked = seeds.join(counts, "gram", "left").withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.coalesce("n", F.lit(0)), "gram", "place")))
    return scratch.table(ranked.where("rank <= enough").select("gram", "item").distinct(), "rarest")


def _candidates(blocks: DataFrame, items: DataFrame, min_score: float) -> DataFrame:
    """(block, place, key, words) for each document and item that share a seed, dealt like the blocks."""
    seeds = scratch.table(_seeds(items, min_score), "seeds")
    rarest = _rarest(blocks, seeds)
    known = _Map(rarest, rarest.count())

    def met(block: int, rows: pa.Table, _: dict) -> pa.Table:
        places, grams, before = [], [], 0
        for at, part in wordhash.steps(rows.column("text")):
            h, first = word_hashes(part)
            g, where = _pairs(h, first)
            on = known.passes(g)
            text = at + np.searchsorted(first, where[on], "right") - 1
            # a text's seed counts once
            order = np.lexsort((g[on], text))
            text, own = text[order], g[on][order]
            new = np.ones(len(order), bool)
            new[1:] = (text[1:] != text[:-1]) | (own[1:] != own[:-1])
            places.append(text[new])
            grams.append(own[new])
        place = rows.column("place").to_numpy()[np.concatenate([*places, np.zeros(0, np.int64)])]
        gram = np.concatenate([*grams, np.zeros(0, np.uint64)]).view(np.int64)
        return pa.table({"block": pa.array(np.full(len(gram), block)), "place": pa.array(place), "gram": pa.array(gram)})

    pairs = exchange.each_block(blocks, None, met, "block long, place long, gram long").join(rarest, "gram").select("block", "place", "item").distinct()
    return exchange.by_block(pairs.join(items, "item").select("block", "place", "key", "words"))


def _passages(g: np.ndarray, words: np.ndarray, order: np.ndarray, pairs: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Parts of a text that hold need - 1 of an item's pairs, wide enough for all alignments with them.

    g: the text's pairs; pairs: the item's in ascending order, ``order`` their places.
    """
    n = len(words)
    low, high = np.searchsorted(pairs, g, "left"), np.searchsorted(pairs, g, "right")
    on = np.flatnonzero(high > low)
    many = (high - low)[on]
    of = np.repeat(on, many)
    place = order[np.arange(len(of)) + np.repeat(low[on] - (np.cumsum(many) - many), many)]
    begin = of - place
    by = np.argsort(begin, kind="stable")
    begin, place, room = begin[by], place[by], n // 2 + 2
    # pairs of one alignment are no further apart than the words left out of it
    cuts = np.flatnonzero(np.diff(begin) > n + 2 * room) + 1
    edges = np.concatenate([[0], cuts, [len(begin)]]) if len(begin) else np.zeros(1, np.int64)
    return [(int(begin[a]) - room, int(begin[b - 1]) + n + room) for a, b in zip(edges[:-1], edges[1:], strict=True) if len(np.unique(place[a:b])) >= need - 1]


def _found(column: pa.Array, texts: np.ndarray, items: list[bytes], min_score: float) -> list[tuple[float, int, int] | None]:
    """For each pair of a text and an item (its words): the score by the item's length and the words of the text aligned."""
    out: list[tuple[float, int, int] | None] = []
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for t, blob in zip(texts.tolist(), items, strict=True):
        if t not in known:  # pairs come by text
            known = {t: (h := word_hashes(column.slice(t, 1))[0], wordhash.windows(h, SEED))}
        h, g = known[t]
        words = np.frombuffer(blob, "<u8")
        pairs, need, best = wordhash.windows(words, SEED), needed(len(words), min_score), None
        order = np.argsort(pairs, kind="stable")
        for low, high in _passages(g, words, order, pairs[order], need):
            low, high = max(low, 0), min(high, len(h))
            score, a, b = smith_waterman(words, h[low:high])
            if score >= need and (best is None or score / len(words) > best[0]):
                best = score / len(words), low + a, low + b
        out.append(best)
    return out


def _aligned(rows: pa.Table, met: pa.Table, min_score: float) -> tuple[pa.Table, list[int], list[tuple[float, int, int]]]:
    """(candidates of a block that are leaks, their texts' numbers in the block, what was found)."""
    met = met.sort_by("place")
    number = {p: i for i, p in enumerate(rows.column("place").to_pylist())}
    texts = np.array([number[p] for p in met.column("place").to_pylist()], np.int64)
    found = _found(rows.column("text").combine_chunks(), texts, met.column("words").to_pylist(), min_score)
    on = [i for i, x in enumerate(found) if x]
    return met.take(pa.array(on, pa.int64())), texts[on].tolist(), [found[i] for i in on]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """(id_col, item_col, score, first_word, last_word) of every document that holds an item.

    score: alignment score over the item's words, 1 being a whole copy.  It is at least min_score,
    or less where a part of a long item alone scores LEAK_WORDS.  Words are counted from 0, last_word exclusive.  Items of
    fewer than LEAST words, null texts included, are no evidence.  Null and empty texts hold nothing; repeated rows are
    reported one by one; repeated items too.  A very long text is one block.  An empty benchmark gives no rows.
    Other columns are ignored; id_col and item_col must differ from each other and from what is returned.
    """
    blocks = exchange.write_blocks(docs, id_col, text_col)
    met = _candidates(blocks, _items(benchmark, item_col, item_text_col), min_score)

    def report(rows: pa.Table, met: pa.Table) -> pa.Table:
        rows = exchange.in_order(rows)
        own, texts, found = _aligned(rows, met, min_score)
        score, a, b = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({id_col: rows.column("id").take(pa.array(texts, pa.int64())), item_col: own.column("key"), "score": pa.array(score, pa.float64()), "first_word": pa.array(a, pa.int64()), "last_word": pa.array(b, pa.int64())})

    kinds = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = f"`{id_col}` {kinds[0].simpleString()}, `{item_col}` {kinds[1].simpleString()}, score double, first_word long, last_word long"
    return blocks.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(wordhash.tidied(report), schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs that hold no test item, with all their columns; see leaks."""
    rest = [c for c in docs.columns if c != text_col]
    names = {c: f"more{i}" for i, c in enumerate(rest)}
    blocks = exchange.write_blocks(docs, None, text_col, {n: F.col(f"`{c}`") for c, n in names.items()})
    met = _candidates(blocks, _items(benchmark, item_col, item_text_col), min_score)

    def sieve(rows: pa.Table, met: pa.Table) -> pa.Table:
        rows = exchange.in_order(rows)
        keep = np.ones(rows.num_rows, bool)
        keep[_aligned(rows, met, min_score)[1]] = False
        return rows.filter(pa.array(keep)).drop_columns(["block", "place"])

    clean = blocks.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(wordhash.tidied(sieve), blocks.drop("block", "place").schema)
    return clean.select(*[(F.col("text").cast(docs.schema[c].dataType) if c == text_col else F.col(names[c])).alias(c) for c in docs.columns])
