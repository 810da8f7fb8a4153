"""Phrase mining: n-gram counts from word-id suffix arrays, scored and thinned as collocations.

Each shard of documents has a suffix array over its word ids.  Suffixes are ranked by prefix doubling: by their
first word, then pairs of ranks give the first two words, pairs of those the first four, which is as
far as phrases go.  In the array's order the common prefixes (LCP) of neighbours tell the
intervals of equal n-grams and so each n-gram's count in the shard.

Counts are merged over all shards by key.  A phrase that is frequent enough has frequent parts only, so shards first ask
for words and pairs, by hash, and go on with longer phrases whose pairs are all frequent.  The n-grams
that may be frequent, and only those, then come with their text, one row a shard, and are summed exactly; equal
hashes of different n-grams cost rows, never counts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import exchange, scratch, wordhash

LONGEST = 4
UNKNOWN = "und"
SHARES = 8
#: What parts pieces, and what parts words within one.
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAPS = _ENDS.copy()
_GAPS[[0x20, 0x09]] = True


class Suffixes:
    """The suffix array of a shard's words, each suffix ending with its piece; languages have ids of their own."""

    def __init__(self, texts: pa.Array, langs: list[str | None]):
        self.h, self.start, self.end, first, self.raw = wordhash.words(texts, lower=True, gaps=_GAPS)
        self.langs = sorted({x if x is not None else UNKNOWN for x in langs})
        number = {x: i for i, x in enumerate(self.langs)}
        own = np.array([number[x if x is not None else UNKNOWN] for x in langs], np.int64)
        self.lang = np.repeat(own, np.diff(first))
        self.n_words = np.bincount(own, weights=np.diff(first), minlength=len(self.langs)).astype(np.int64)
        seed = np.array([int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "little") for x in self.langs], np.uint64)
        self.seed = seed[self.lang]
        n = len(self.h)
        # words up to the end of the piece, counted from each word
        opens = np.zeros(n + 1, bool)
        opens[first] = True
        if n:
            low = int(self.start[0])
            ends = np.concatenate([[0], np.cumsum(_ENDS[self.raw[low : int(self.end[-1])]], dtype=np.int32)])
            opens[1:n] |= ends[self.start[1:] - low] != ends[self.end[:-1] - low]
        opens[0], opens[n] = True, True
        at = np.flatnonzero(opens)
        self.room = np.repeat(at[1:], np.diff(at)) - np.arange(n)
        self._double()

    def _double(self) -> None:
        one = self.word = pd.factorize(wordhash.mix(self.h + self.seed))[0] + 1
        two, _ = self._pairs(one, one, 1)
        four, self.order = self._pairs(two, two, 2)
        o, room = self.order, self.room[self.order]
        same = lambda rank: np.concatenate([[False], rank[1:] == rank[:-1]]) if len(rank) else np.zeros(0, bool)
        third = np.where(room > 2, one[np.minimum(o + 2, max(len(o) - 1, 0))], 0)
        pair = same(two[o]) & (room > 1)
        triple = pair & same(third) & (room > 2)
        # words that a suffix has in common with the one before it
        self.common = same(one[o]).astype(np.int8) + pair + triple + (triple & same(four[o]) & (room > 3))

    def _pairs(self, first: np.ndarray, second: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(ranks by ``first`` and then ``second`` a step further, their order); suffixes that end there come before others."""
        n = len(first)
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = second[step:]
        after[self.room <= step] = 0
        key = first * (int(second.max(initial=0)) + 1) + after
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])[:n])
        return rank, order

    def intervals(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a word where each distinct n-gram begins, its count, the n-gram of each word or -1)."""
        holds = self.room[self.order] >= size
        opens = holds & (self.common < size)
        group = np.cumsum(opens) - 1
        of = np.full(len(self.h), -1, np.int64)
        of[self.order[holds]] = group[holds]
        return self.order[opens], np.bincount(group[holds], minlength=int(opens.sum())), of

    def keys(self, size: int, at: np.ndarray) -> np.ndarray:
        """A hash of language and n-gram, equal in all shards."""
        if not len(at):
            return np.zeros(0, np.uint64)
        return wordhash.mix(wordhash.windows(self.h, size, seed=size)[at] ^ wordhash.mix(self.seed[at] + np.uint64(size)))

    def phrases(self, at: np.ndarray, size: int) -> pa.Array:
        """The n-grams that begin at these words, joined by spaces."""
        if not len(at):
            return pa.array([], pa.string())
        # each distinct word is cut out once
        if not hasattr(self, "cut"):
            lead = np.zeros(int(self.word.max()) + 1, np.int64)
            lead[self.word[::-1]] = np.arange(len(self.word))[::-1]
            data = self.raw.tobytes()
            self.cut = pa.array([data[s:e].lower().decode() for s, e in zip(self.start[lead].tolist(), self.end[lead].tolist(), strict=True)], pa.string())
        return pc.binary_join_element_wise(*[self.cut.take(pa.array(self.word[at + k])) for k in range(size)], " ")


def _asked(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, counts up to 255, each key's place among the distinct) of several lists of keys with counts."""
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate([c for _, c in parts]), minlength=len(keys))
    return keys, np.minimum(counts, 255).astype(np.uint8), inverse


class _Levels:
    """What a shard asks at each level and what it knows from the answers; made anew from its text."""

    def __init__(self, rows: pa.Table, have: dict[int, np.ndarray]):
        self.s = Suffixes(rows.column("text"), rows.column("id").to_pylist())
        self.found = {n: self.s.intervals(n) for n in (1, 2)}
        self._ask((1, 2), have.get(1))
        if 1 in have:
            pair = np.zeros(len(self.s.h) + LONGEST, bool)
            of = self.found[2][2]
            told = self.frequent[2]
            pair[: len(of)][of >= 0] = told[of[of >= 0]]
            for n in range(3, LONGEST + 1):
                at, count, of = self.s.intervals(n)
                on = np.all([pair[at + k] for k in range(n - 1)], axis=0) if len(at) else np.zeros(0, bool)
                self.found[n] = at[on], count[on], of
            self._ask(tuple(range(3, LONGEST + 1)), have.get(2))

    def _ask(self, sizes: tuple[int, ...], told: np.ndarray | None) -> None:
        parts = [(self.s.keys(n, self.found[n][0]), self.found[n][1]) for n in sizes]
        self.keys, self.counts, inverse = _asked(parts)
        if told is None and len(self.keys):
            return
        cuts = np.cumsum([0, *(len(k) for k, _ in parts)])
        known = (told if told is not None else np.zeros(0, np.uint8)).astype(bool)
        self.frequent = getattr(self, "frequent", {}) | {n: known[inverse[a:b]] for n, a, b in zip(sizes, cuts[:-1], cuts[1:], strict=True)}


def ngrams(docs: DataFrame, least: int = 30, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, size, phrase, f), (lang, n)): n-grams of 1 to 4 words found ``least`` times or more, and words by language.

    f is the number of occurrences within pieces, overlaps included, over all documents; n counts all words.  Both
    are written tables.
    """
    shards = scratch.partitions(docs.sparkSession)
    blocks = exchange.write_blocks(docs, lang_col, text_col)
    answers = None
    for level in (1, 2):

        def put(block: int, rows: pa.Table, have: dict, level: int = level) -> list[dict]:
            own = _Levels(rows, have)
            return exchange.questions(block, level, own.keys, own.counts, shards)

        def often(kind: int, keys: np.ndarray, data: np.ndarray, rank: np.ndarray, inverse: np.ndarray) -> np.ndarray:
            return (np.bincount(inverse, weights=data, minlength=len(keys)) >= least).astype(np.uint8)[inverse]

        new = exchange.answer(exchange.ask(blocks, answers, put), often)
        answers = new if answers is None else answers.unionByName(new)

    def told(block: int, rows: pa.Table, have: dict) -> pa.Table:
        own = _Levels(rows, {1: np.zeros(0, np.uint8)} | have)
        names = pa.array(own.s.langs, pa.string())
        parts = [(names, 0, pa.array([""] * len(names), pa.string()), own.s.n_words)]
        for n, (at, many, _) in own.found.items():
            on = own.frequent[n]
            parts.append((names.take(pa.array(own.s.lang[at[on]])), n, own.s.phrases(at[on], n), many[on]))
        made = [pa.table({"lang": a, "size": pa.array(np.full(len(a), n, np.int32)), "phrase": p, "f": pa.array(f.astype(np.int64))}) for a, n, p, f in parts]
        return pa.concat_tables(made).combine_chunks()

    each = exchange.each_block(blocks, answers, told, "lang string, size int, phrase string, f long")
    total = scratch.table(each.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")), "ngrams")
    return total.where((F.col("size") > 0) & (F.col("f") >= least)), total.where("size = 0").select("lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, least: int = 30, contained: int = 80, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to 4 words.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and those into words at spaces and tabs.  A
    phrase occurs a times, ``least`` or more.  Cut in two, its parts occur l and r times, and the cut scores
    floor(2000000 a / (l + r)); the cut that scores least counts, of equal ones the first.  A phrase within a longer one
    that occurs ``contained`` percent as often is dropped.  Rank goes by score, then a, both descending, then phrase by
    bytes.  Null texts are empty, a null language is ``und``; empty texts and an empty table bring nothing, repeated rows
    count each, very long texts are one shard.  Other columns of docs are ignored.
    """
    counts, words = ngrams(docs, least, text_col, lang_col)
    found = counts.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda first, length: F.array_join(F.slice("w", first, length), " ")
    cuts = found.select("lang", "size", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "size", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    side = lambda phrase, f: counts.select("lang", F.col("phrase").alias(phrase), F.col("f").alias(f))
    # decimals, as products can pass 64 bits
    score = F.expr("(cast(a as decimal(20,0)) * cast(2000000 as decimal(8,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("b")).select("lang", "phrase", "b.a", "b.l", "b.r", "b.score")
    inner = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    longer = found.where("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    gone = F.expr(f"100 * cast(longer as decimal(20,0)) >= {contained} * cast(a as decimal(20,0))")
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~gone).drop("longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language may hold most phrases: the best of its shares first, then of SHARES shares together, down to one
    shares = scratch.partitions(docs.sparkSession)
    ranked = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    while True:
        ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
        if shares == 1:
            break
        shares, ranked = -(-shares // SHARES), ranked.withColumn("share", F.expr(f"share div {SHARES}"))
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
