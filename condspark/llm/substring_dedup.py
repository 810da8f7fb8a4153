"""Substring dedup by level-wise doubling.

A window of ``size`` words is repeated only if every shorter window inside it is.  So windows
are counted over the whole corpus at a short length first, at content-chosen places, and only
those repeated there are extended to twice the length, until the full length, where every
window around a survivor is counted.  Nothing is sampled: with short windows of k words and
the place of the least hash among each ``size - k + 1`` successive ones, every full window
holds a chosen place, and equal windows choose equal places; of the two doubled windows at
that place (to its left and to its right) one at least lies within the full window.

Counts are by 64-bit hash up to the last level and by 128 bits there, of two hashes that share nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange, scratch, wordhash


def _anchors(h: np.ndarray, first: np.ndarray, k: int, span: int) -> np.ndarray:
    """Places of the least k-word hash in each run of ``span`` successive ones, within one text."""
    out = []
    win = wordhash.windows(h, k)
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = int(b - a) - k + 1
        if n < span:
            continue
        own = win[a : a + n]
        # sliding minimum by blocks of span: suffix minima of one block meet prefix minima of the next
        fill = -n % span
        grid = np.append(own, np.full(fill, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, span)
        before = np.minimum.accumulate(grid, axis=1).ravel()[:n]
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
        least = np.minimum(after[: n - span + 1], before[span - 1 :])
        # every place that equals the least of a run that covers it: ties all count
        cover = np.zeros(n, dtype=bool)
        lows = np.unique(least)
        at = np.searchsorted(lows, own)
        at[at == len(lows)] = 0
        cover = lows[at] == own
        out.append(np.flatnonzero(cover) + a)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
    return keys, inverse, np.minimum(count, 255).astype(np.uint8)


class _Levels:
    """What a block knows after each level; recomputed from its text, which is cheaper than moving it."""

    def __init__(self, texts: pa.Array, size: int, have: dict[int, np.ndarray]):
        self.h, self.start, self.end, self.first, self.raw = wordhash.words(texts)
        self.size, self.k = size, max(1, size // 4 + 1)
        self.doc_end = np.repeat(self.first[1:], np.diff(self.first))
        self.doc_begin = np.repeat(self.first[:-1], np.diff(self.first))
        k = self.k
        self.at = _anchors(self.h, self.first, k, size - k + 1)
        self.keys = wordhash.windows(self.h, k)[self.at]
        self.level = 1
        if 1 in have:
            self._double(have[1])
        if 2 in have:
            self._full(have[2])

    def _double(self, repeated: np.ndarray) -> None:
        _, inverse, _ = _distinct(self.keys)
        at = self.at[repeated[inverse].astype(bool)] if len(inverse) else self.at
        k, two = self.k, min(2 * self.k, self.size)
        ahead = at[at + two <= self.doc_end[at]] if len(at) else at
        behind = at + k - two
        behind = behind[behind >= self.doc_begin[at]] if len(at) else at
        self.at = np.unique(np.concatenate([ahead, behind]))
        self.keys = wordhash.windows(self.h, two)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.two, self.level = two, 2

    def _full(self, repeated: np.ndarray) -> None:
        _, inverse, _ = _distinct(self.keys)
        at = self.at[repeated[inverse].astype(bool)] if len(inverse) else self.at
        n = len(self.h)
        mark = np.zeros(n + 1, np.int64)
        if len(at):
            np.add.at(mark, np.maximum(at + self.two - self.size, self.doc_begin[at]), 1)
            np.add.at(mark, np.minimum(at, self.doc_end[at] - self.size) + 1, -1)
        cand = np.flatnonzero(np.cumsum(mark)[:n] > 0)
        self.at = cand[cand + self.size <= self.doc_end[cand]] if len(cand) else cand
        self.keys = wordhash.windows(self.h, self.size)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        # words and windows hashed anew, so that nothing is shared with the keys
        other = wordhash.spans(self.raw, self.start, self.end, seed=1) if len(self.at) else self.h
        self.more = wordhash.windows(other, self.size, seed=1)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.level = 3

    def question(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys and what goes along: the local count, at the last level with a second hash."""
        if self.level < 3:
            keys, _, count = _distinct(self.keys)
            return keys, count
        keys, count, more, _ = self.full()
        out = np.empty(len(keys), dtype=[("n", "u1"), ("more", "<u8")])
        out["n"], out["more"] = count, more
        return keys, out

    def full(self):
        both = np.empty(len(self.keys), dtype=[("a", "<u8"), ("b", "<u8")])
        both["a"], both["b"] = self.keys, self.more
        order = np.lexsort((self.more, self.keys))
        new = np.ones(len(order), dtype=bool)
        if len(order):
            new[1:] = (both["a"][order][1:] != both["a"][order][:-1]) | (both["b"][order][1:] != both["b"][order][:-1])
        group = np.cumsum(new) - 1
        inverse = np.empty(len(order), np.int64)
        inverse[order] = group
        lead = order[new]
        count = np.minimum(np.bincount(group, minlength=len(lead)), 255).astype(np.uint8)
        return self.keys[lead], count, self.more[lead], inverse


def _repeated(kind: int, keys: np.ndarray, data: np.ndarray, rank: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    if kind < 3:
        total = np.bincount(inverse, weights=data, minlength=len(keys))
        return (total[inverse] > 1).astype(np.uint8)
    order = np.lexsort((data["more"], inverse))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (inverse[order][1:] != inverse[order][:-1]) | (data["more"][order][1:] != data["more"][order][:-1])
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=data["n"][order])
    out = np.empty(len(order), np.uint8)
    out[order] = total[group] > 1
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 35) -> DataFrame:
    """Remove every word covered by a window of ``size`` words that also starts elsewhere.

    Returns (id_col, text, n_words, n_removed, kept_text), a row for each row of docs.  The first
    copy goes as well: windows are judged on the input.  A null text has no words and kept text "";
    a text shorter than ``size`` words keeps all.  Repeated rows are separate documents, so from
    ``size`` words on they lose everything.  kept_text joins kept words by one space.  A very long text is one block; an empty
    table gives no rows; other columns are ignored.
    """
    if size < 2:
        raise ValueError("size must be at least 2")
    shards = scratch.partitions(docs.sparkSession)
    blocks = exchange.write_blocks(docs, id_col, text_col)
    answers = None
    for level in (1, 2, 3):

        def put(block: int, rows: pa.Table, have: dict, level: int = level) -> list[dict]:
            keys, data = _Levels(rows.column("text"), size, have).question()
            return exchange.questions(block, level, keys, data, shards)

        new = exchange.answer(exchange.ask(blocks, answers, put), _repeated)
        answers = new if answers is None else answers.unionByName(new)

    def cleaned(block: int, rows: pa.Table, have: dict) -> pa.Table:
        s = _Levels(rows.column("text"), size, have)
        gone = np.zeros(len(s.h) + 1, np.int64)
        if 3 in have:
            hit = s.at[have[3][s.full()[3]].astype(bool)]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + size, -1)
        keep = np.cumsum(gone)[: len(s.h)] == 0
        kept = []
        data = s.raw.tobytes()
        for a, b in zip(s.first[:-1], s.first[1:], strict=True):
            on = np.flatnonzero(keep[a:b]) + a
            kept.append(b" ".join(data[x:y] for x, y in zip(s.start[on].tolist(), s.end[on].tolist(), strict=True)).decode())
        n = np.diff(s.first)
        total = np.concatenate([[0], np.cumsum(~keep)])
        removed = total[s.first[1:]] - total[s.first[:-1]]
        return pa.table({id_col: rows.column("id"), "text": rows.column("text"), "n_words": pa.array(n.astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)), "kept_text": pa.array(kept, pa.string())})

    kind = docs.schema[id_col].dataType.simpleString()
    return exchange.each_block(blocks, answers, cleaned, f"`{id_col}` {kind}, text string, n_words long, n_removed long, kept_text string")


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
