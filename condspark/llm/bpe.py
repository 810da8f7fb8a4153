"""Fast encoding by the tokenizers library: each distinct piece of a batch is encoded once.

Both pre-tokenizers used here split a text before any ASCII white space that follows other
characters, so a text's ids are those of its pieces in order.  Where a text holds other
Unicode white space that rule doesn't hold, and the whole text is encoded at once.

Distinct pieces are found by 64-bit hash, told apart by a second one (words up to eight bytes differ in the
first already), and go to the tokenizer as one long text; the bytes
that each id stands for show where a piece's ids end.  If those bytes don't add up, the pieces
are encoded one by one.  A worker process remembers up to ``CACHE`` pieces.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa

from . import wordhash

_OTHER_SPACE = re.compile("[\x85\xa0  -     　]")
WORD_END = "</w>"
CACHE = 1_500_000


def _leads(codes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n codes comes first."""
    lead = np.empty(n, np.int64)
    lead[codes[::-1]] = np.arange(len(codes))[::-1]
    return lead


class Encoder:
    """keep_space: white space belongs to the piece after it; else the tokenizer drops it."""

    def __init__(self, file: str, keep_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.keep_space = keep_space
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes_of = np.zeros(self.size, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token.removesuffix(WORD_END) if not keep_space else token)
        if not keep_space:
            from tokenizers import normalizers

            # joined pieces are normalised once, before they are encoded
            self.plain = Tokenizer.from_file(file)
            self.plain.normalizer = normalizers.Sequence([])
        else:
            self.plain = self.tokenizer
        self.forget()

    def forget(self) -> None:
        self.keys, self.other = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.length, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, np.uint32)

    def _remember(self, keys: np.ndarray, other: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        if len(self.keys) + len(keys) > CACHE:
            keep = np.flatnonzero(self.used > 1)[: CACHE // 2]
            ends = np.cumsum(self.length[keep])
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[keep] - (ends - self.length[keep]), self.length[keep])
            self.keys, self.other, self.ids, self.length = self.keys[keep], self.other[keep], self.ids[at], self.length[keep]
            self.begin, self.used = ends - self.length, np.zeros(len(keep), np.int64)
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys, kind="stable")
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(length) - length])[order]
        self.length = np.concatenate([self.length, length])[order]
        self.used = np.concatenate([self.used, np.zeros(len(keys), np.int64)])[order]
        self.other = np.concatenate([self.other, other])[order]
        self.keys, self.ids = all_keys[order], np.concatenate([self.ids, ids])

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.fromiter((i for ids in made for i in ids), np.uint32), np.fromiter(map(len, made), np.int64, len(made))

    def _joined(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the pieces and how many each has; with keep_space all begin with white space."""
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        size = end - begin + (not self.keep_space)
        ends = np.cumsum(size)
        data = np.full(int(ends[-1]), 0x20, np.uint8)
        at = np.arange(len(data)) + np.repeat(begin - (ends - size), size)
        if self.keep_space:
            data = raw[at]
        else:
            inside = np.ones(len(data), bool)
            inside[ends - 1] = False
            data[inside] = raw[at[inside]]
        text = data.tobytes().decode()
        if not self.keep_space:
            data = np.frombuffer(self.tokenizer.normalizer.normalize_str(text).encode(), np.uint8)
            ends = np.flatnonzero(data == 0x20) + 1
            size = np.diff(ends, prepend=0) - 1
        # the tokenizer takes about 100 kB at a time
        parts, a = [], 0
        cut = np.searchsorted(ends, np.arange(100_000, int(ends[-1]) + 100_000, 100_000))
        for b in np.unique(np.minimum(cut + 1, len(ends))):
            parts.append(data[ends[a - 1] if a else 0 : ends[b - 1]].tobytes().decode())
            a = b
        ids = np.concatenate([np.asarray(x.ids, np.uint32) for x in self.plain.encode_batch_fast(parts, add_special_tokens=False)])
        if len(size) == len(begin):
            places = np.cumsum(self.bytes_of[ids])
            last = np.searchsorted(places, np.cumsum(size))
            if len(places) and last[-1] < len(places) and (places[last] == np.cumsum(size)).all() and last[-1] == len(places) - 1:
                return ids, np.diff(last, prepend=-1)
        return self._each([raw[x:y].tobytes().decode() for x, y in zip(begin.tolist(), end.tolist(), strict=True)])

    def _pieces(self, column: pa.Array):
        """(codes of all pieces, where each text's begin, ids of the distinct ones, where those begin)."""
        texts = column.to_pylist()
        odd = [i for i, t in enumerate(texts) if t and not t.isascii() and _OTHER_SPACE.search(t)]
        if odd:
            gone = set(odd)
            column = pa.array([None if i in gone else t for i, t in enumerate(texts)], pa.string())
        offsets, raw = wordhash.string_buffers(column)
        h, start, end, first, _ = wordhash.words(column)
        n = len(texts)
        if self.keep_space:
            begin = np.empty_like(start)
            begin[1:] = end[:-1]
            filled = np.flatnonzero(np.diff(first))
            begin[first[:-1][filled]] = offsets[:-1][filled]
            gap = start - begin
            key = wordhash.mix(h + wordhash.mix(gap.astype(np.uint64) << np.uint64(8) | np.where(gap == 1, raw[np.minimum(begin, max(len(raw) - 1, 0))] if len(raw) else 0, 0).astype(np.uint64)))
            for i in np.flatnonzero(gap > 1).tolist():
                key[i] ^= np.uint64(hash(raw[begin[i] : start[i]].tobytes()) & 0xFFFFFFFFFFFFFFFF)
        else:
            begin, key = start, h
        other = np.zeros(len(h), np.uint64)
        long = np.flatnonzero(end - start > 8)
        other[long] = wordhash.spans(raw, start[long], end[long], seed=1)
        codes, distinct = pd.factorize(key)
        lead = _leads(codes, len(distinct))
        apart = other != other[lead][codes]
        if apart.any():  # words that the first hash takes for equal
            key = np.where(apart, wordhash.mix(key ^ wordhash.mix(other)), key)
            codes, distinct = pd.factorize(key)
            lead = _leads(codes, len(distinct))
        joined = (start[lead] > begin[lead]) if self.keep_space else np.ones(len(lead), bool)
        place = np.searchsorted(self.keys, distinct)
        hit = np.zeros(len(distinct), bool)
        if len(self.keys):
            place = np.minimum(place, len(self.keys) - 1)
            known = self.keys[place] == distinct
            hit = known & (self.other[place] == other[lead])
            joined &= ~known | hit  # another word of the same hash is encoded each time
        joined &= ~hit
        ids_a, len_a = self._joined(raw, begin[lead[joined]], end[lead[joined]])
        alone = ~joined & ~hit
        ids_b, len_b = self._each([raw[x:y].tobytes().decode() for x, y in zip(begin[lead[alone]].tolist(), end[lead[alone]].tolist(), strict=True)])
        # white space at the ends of texts, and texts with other white space
        extra_at, extra = [], []
        if self.keep_space:
            stop = offsets[:-1].copy()
            filled = np.flatnonzero(np.diff(first))
            stop[filled] = end[first[1:][filled] - 1]
            for i in np.flatnonzero(offsets[1:] > stop).tolist():
                extra_at.append(i)
                extra.append(raw[stop[i] : offsets[i + 1]].tobytes().decode())
        for i in odd:
            extra_at.append(i)
            extra.append(texts[i])
        order = np.argsort(extra_at, kind="stable")
        extra_at, extra = [extra_at[i] for i in order], [extra[i] for i in order]
        ids_c, len_c = self._each(extra)
        lengths = np.empty(len(distinct) + len(extra), np.int64)
        begins = np.empty_like(lengths)
        lengths[: len(distinct)][hit] = self.length[place[hit]]
        begins[: len(distinct)][hit] = self.begin[place[hit]]
        self.used[place[hit]] += 1
        ids, base = self.ids, len(self.ids)
        pos = np.flatnonzero(joined), np.flatnonzero(alone), np.arange(len(distinct), len(lengths))
        for p, own in zip(pos, (len_a, len_b, len_c), strict=True):
            lengths[p] = own
            begins[p] = base + np.cumsum(own) - own
            base += int(own.sum())
        ids = np.concatenate([ids, ids_a, ids_b, ids_c])
        self._remember(distinct[joined], other[lead[joined]], ids_a, len_a)
        if extra:
            codes = np.insert(codes, first[1:][extra_at], np.arange(len(distinct), len(lengths)))
            first = first + np.concatenate([[0], np.cumsum(np.bincount(extra_at, minlength=n))])
        return codes, first, ids, begins, lengths

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids uint32[], cuts int64[n + 1]) of the texts; a null is empty."""
        codes, first, ids, begins, lengths = self._pieces(column)
        length = lengths[codes]
        ends = np.concatenate([[0], np.cumsum(length)])
        return ids[np.repeat(begins[codes] - ends[:-1], length) + np.arange(ends[-1])], ends[first]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(file: str, keep_space: bool) -> Encoder:
    """One for each worker process and file."""
    if (file, keep_space) not in _encoders:
        _encoders[file, keep_space] = Encoder(file, keep_space)
    return _encoders[file, keep_space]


steps = wordhash.steps
