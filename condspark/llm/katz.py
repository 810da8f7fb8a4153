"""Katz backoff language model: counting, storing and scoring at corpus scale.

A text is its words, A-Z taken as a-z and hashed, then one end token; the end token also stands before the first
word as context.  Counts r of at most ``K`` are discounted by Good and Turing's ratios; where
the counts of counts give no ratio within (0, 1), (r - b) / r with b = n1 / (n1 + 2 n2) is
taken.  A context all of whose successors are above ``K`` has its total raised by one, as it
would leave nothing for words it was never seen with.  The backoff weight of a context is
(1 - sum of discounted probabilities of its successors) / (1 - sum of their lower-order
probabilities), so the probabilities after any context sum to one over the known words and
one class of unknown words.

The n-gram counts are kept in tables by hash shard (see ``exchange``).  Each block of
documents asks for its own distinct n-grams and then evaluates every token by recursion from
the highest order.  A block that a shard names as owner of an n-gram adds its share to the
context's sums, so each n-gram of the model counts once; the shard tells the weight to the
blocks that back off from the context.  Contexts of one block alone are weighed where they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange, scratch, wordhash

K = 5
END = np.uint64(0x5851F42D4C957F2D)
COUNT = np.dtype([("c", "<u8"), ("own", "u1")])  # own: 1 if this block owns the n-gram, 2 more if no other asked
RANKED = np.dtype([*COUNT.descr, ("step", "<u4")])  # step: from the last n-gram in its shard that others asked about too
BLOCK = 8_000_000
SHARE = np.dtype([("seen", "<f8"), ("low", "<f8"), ("total", "<u8"), ("back", "u1")])  # back: 1 if this block backs off from the context
WEIGHT = np.dtype([("alpha", "<f8"), ("raised", "u1")])  # alpha: 0 where the block doesn't back off
ALPHA = 100


def discounts(n: np.ndarray) -> np.ndarray:
    """Factor for each count 0..K (above K: 1) from counts of counts n[1..K + 1]."""
    d = np.ones(K + 1)
    rest = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    b = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    for r in range(1, K + 1):
        ratio = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
        good = (ratio - rest) / (1 - rest) if rest < 1 else 0.0
        d[r] = good if 0 < good < 1 else (r - b) / r
    d[0] = 0
    return d


def _discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c > K, c, (d * np.arange(K + 1))[np.minimum(c, K)])


class _Stream:
    """A block's tokens with their n-grams of every order, and what the tables say of them."""

    def __init__(self, texts: pa.Array, order: int, have: dict[int, np.ndarray], model: dict | None):
        h, _, _, first, _ = wordhash.words(texts, lower=True)
        docs = len(first) - 1
        of = np.repeat(np.arange(docs), np.diff(first))
        self.tokens = np.full(len(h) + 2 * docs, END, np.uint64)
        self.tokens[np.arange(len(h)) + 2 * of + 1] = h
        self.first = first + 2 * np.arange(docs + 1)
        length = np.diff(self.first)
        self.doc = np.repeat(np.arange(docs), length)
        self.depth = np.arange(len(self.tokens)) - np.repeat(self.first[:-1], length)
        self.single = wordhash.single(self.tokens)
        self.have, self.model, self.made = have, model, {}

    def grams(self, m: int):
        """(places of last tokens, distinct keys, inverse) of the m-grams that predict a token."""
        if m not in self.made:
            at = np.flatnonzero(self.depth >= max(1, m - 1))
            keys = wordhash.windows_of(self.single, m)[at - m + 1] if len(at) else np.zeros(0, np.uint64)
            self.made[m] = at, *_unique(keys)
        return self.made[m]

    def count(self, m: int) -> np.ndarray:
        return self.have.get(m, np.zeros(0, COUNT))

    def contexts(self, m: int):
        """The m-grams' first m - 1 tokens: (places among the distinct (m - 1)-grams, inverse over the m-grams' places)."""
        if -m not in self.made:
            at, (below, keys, inverse) = self.grams(m)[0], self.grams(m - 1)
            of = np.zeros(len(self.tokens), np.int64)
            of[below] = inverse
            if m == 2:  # the end token before a text is the one after it
                of[self.first[:-1]] = of[self.first[1:] - 1]
            of = of[at - 1]
            used = np.zeros(len(keys), bool)
            used[of] = True
            self.made[-m] = np.flatnonzero(used), (np.cumsum(used) - 1)[of]
        return self.made[-m]

    def ranks(self, m: int, shards: int):
        """(shard, number there) of the distinct m-grams; numbers hold for those that others asked about too."""
        shard = exchange.shard_of(self.grams(m)[1], shards)
        step = self.count(m)["step"].astype(np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(step)])
        return shard, total[1:] - total[np.searchsorted(shard, shard)]

    def probability(self, m: int) -> np.ndarray:
        """Of each token of the block (by place), by the model of order m or the order its place allows."""
        if m == 1:
            at, _, inverse = self.grams(1)
            c = self.count(1)["c"].astype(np.int64)
            known = _discounted(c, self.model["d"][1]) / self.model["total"]
            out = np.zeros(len(self.tokens))
            out[at] = np.where(c > 0, known, self.model["unknown"])[inverse]
            return out
        out = self.probability(m - 1)
        at, _, inverse = self.grams(m)
        count = self.count(m)["c"].astype(np.int64)
        contexts, of = self.contexts(m)
        alone = self.alone(m)
        weights = np.empty(len(contexts), WEIGHT)
        weights[~alone] = self.have.get(ALPHA + m, np.zeros(0, WEIGHT))
        mine = self.shares(m, out, alone)[alone]
        weights[alone] = weigh(mine["seen"], mine["low"], mine["total"].astype(np.float64))
        # a context is followed by a token wherever it stands, so its total is its own count
        total = (self.count(m - 1)["c"][contexts].astype(np.float64) + weights["raised"])[of]
        lower = np.flatnonzero((count == 0)[inverse])
        with np.errstate(divide="ignore", invalid="ignore"):
            p = _discounted(count, self.model["d"][m])[inverse] / total
        p[lower] = weights["alpha"][of[lower]] * out[at[lower]]
        out[at] = p
        return out

    def alone(self, m: int) -> np.ndarray:
        """Whether only this block has a context of the m-grams."""
        return (self.count(m - 1)["own"][self.contexts(m)[0]] & 2).astype(bool)

    def shares(self, m: int, low: np.ndarray, which: np.ndarray) -> np.ndarray:
        """This block's part of the sums of the contexts of m-grams in ``which``."""
        at, keys, inverse = self.grams(m)
        place = np.zeros(len(keys), np.int64)
        place[inverse] = np.arange(len(at))
        contexts, of = self.contexts(m)
        to, own = of[place], self.count(m)
        mine = np.flatnonzero((own["own"] & 1).astype(bool) & (own["c"] > 0) & which[to])
        to, c = to[mine], own["c"][mine].astype(np.int64)
        out = np.zeros(len(contexts), SHARE)
        out["seen"] = np.bincount(to, weights=_discounted(c, self.model["d"][m]), minlength=len(contexts))
        out["low"] = np.bincount(to, weights=low[at[place[mine]]], minlength=len(contexts))
        out["total"] = np.bincount(to, weights=c, minlength=len(contexts))
        return out


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the inverse.  Sorts high bits with the place below them; where those bits don't tell keys apart, whole keys."""
    bits = np.uint64(max(1, len(keys).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    order = (np.sort(keys & ~mask | np.arange(len(keys), dtype=np.uint64)) & mask).astype(np.int64)
    sorted_keys = keys[order]
    if (sorted_keys[1:] < sorted_keys[:-1]).any():
        order = np.argsort(keys)
        sorted_keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return sorted_keys[new], inverse


def _ranked(kind: int, keys: np.ndarray, data: np.ndarray, rank: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Counts, and short numbers for the n-grams of several blocks to ask about them again."""
    counted = _counted(kind, keys, data, rank, inverse)
    out = np.zeros(len(counted), RANKED)
    out["c"], out["own"] = counted["c"], counted["own"]
    shared = np.flatnonzero(counted["own"] < 2)
    number = np.zeros(len(keys), np.int64)
    number[inverse[shared]] = 1
    number = (np.cumsum(number) - 1)[inverse[shared]]
    step = np.diff(number, prepend=0)
    begins = np.diff(rank[shared], prepend=-1) != 0
    step[begins] = number[begins]
    out["step"][shared] = step
    return out


def _counted(kind: int, keys: np.ndarray, data: np.ndarray, rank: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    total = np.bincount(inverse, weights=data, minlength=len(keys)).astype(np.uint64)
    lead = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(lead, inverse, rank)
    out = np.empty(len(inverse), COUNT)
    alone = np.bincount(inverse, minlength=len(keys)) == 1
    out["c"], out["own"] = total[inverse], (lead[inverse] == rank) + 2 * alone[inverse]
    return out


def _stored(kind: int, keys: np.ndarray, data: np.ndarray, rank: np.ndarray, inverse: np.ndarray) -> list[tuple[int, bytes]]:
    """A shard's counts of counts (kind -m) and its part of the model: keys (-10 - m) and counts (-20 - m)."""
    total = np.bincount(inverse, weights=data, minlength=len(keys)).astype(np.int64)
    n = np.bincount(np.minimum(total, K + 2), minlength=K + 3)[: K + 3]
    n[0], n[K + 2] = total.sum(), (total > 0).sum()
    on = total > 0
    return [(-kind, exchange.squeeze(n.astype("<i8"))), (-10 - kind, exchange.pack(keys[on])), (-20 - kind, exchange.squeeze(total[on].astype("<u8")))]


def _weighed(kind: int, keys: np.ndarray, data: np.ndarray, rank: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    out = weigh(*(np.bincount(inverse, weights=data[c], minlength=len(keys)) for c in ("seen", "low", "total")))[inverse]
    out["alpha"][data["back"] == 0] = 0
    return out


def weigh(seen: np.ndarray, low: np.ndarray, total: np.ndarray) -> np.ndarray:
    out = np.empty(len(seen), WEIGHT)
    out["raised"] = total - seen < 1e-9
    raised = total + out["raised"]
    out["alpha"] = np.where(total > 0, (raised - seen) / raised / np.maximum(1 - low, 1e-300), 1.0)
    return out


def katz_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None, order: int = 3) -> DataFrame:
    """Score every text by a Katz model of the rows where ``train`` holds (default: all).

    Returns (id_col, train, n_tokens, n_known, train_tokens, base_score, score): score is the model's
    log10 probability of the text, base_score that of add-0.5 unigrams.  A null text is empty: one end
    token.  A null ``train`` counts as false.  Repeated rows count and score one by one.  With no
    training rows every token is unknown and has probability 1.
    """
    shards = scratch.partitions(docs.sparkSession)
    train = F.coalesce(F.lit(True) if train is None else train, F.lit(False))
    blocks = exchange.write_blocks(docs, id_col, text_col, {"train": train}, BLOCK)

    counted, n = [], np.zeros((order + 1, K + 3), np.int64)
    # the longest first, while little else is kept; single words go with them
    for orders in ([1, order] if order > 1 else [1], *([m] for m in range(order - 1, 1, -1))):

        def ask_counts(block: int, rows: pa.Table, have: dict, orders: list[int] = orders) -> list[dict]:
            s = _Stream(rows.column("text"), order, have, None)
            learn = np.asarray(rows.column("train").combine_chunks().to_numpy(zero_copy_only=False)).astype(np.float64)
            out = []
            for m in orders:
                at, keys, inverse = s.grams(m)
                own = np.bincount(inverse, weights=learn[s.doc[at]], minlength=len(keys)).astype("<u4")
                out += exchange.questions(block, m, keys, own, shards)
            return out

        told, kept = exchange.answer_and_keep(exchange.ask(blocks, None, ask_counts), lambda kind, *x: (_ranked if kind < order else _counted)(kind, *x), _stored)
        counted.append(told)
        n += _counts_of_counts(kept, order)
    model, answers = of_counts(n), exchange.merged(counted, [])
    for m in range(2, order + 1):

        def ask_weights(block: int, rows: pa.Table, have: dict, m: int = m, model: dict = model) -> list[dict]:
            s = _Stream(rows.column("text"), order, have, model)
            low, shared = s.probability(m - 1), ~s.alone(m)
            shard, number = s.ranks(m - 1, shards)
            contexts, of = s.contexts(m)
            sums, asked = s.shares(m, low, shared), contexts[shared]
            sums["back"][of[(s.count(m)["c"] == 0)[s.grams(m)[2]]]] = 1
            return exchange.questions(block, ALPHA + m, number[asked], sums[shared], shards, shard[asked])

        told = exchange.replies(exchange.ask(blocks, answers, ask_weights), _weighed)
        # the last ones go straight to the scores
        answers = exchange.merged([answers], [told]) if m < order else answers.unionByName(exchange.by_block(told))

    def score(block: int, rows: pa.Table, have: dict) -> pa.Table:
        s = _Stream(rows.column("text"), order, have, model)
        at, _, inverse = s.grams(1)
        c = s.count(1)["c"][inverse].astype(np.float64)
        base = np.log10((c + 0.5) / (model["tokens"] + 0.5 * (model["types"] + 1)))
        by = s.doc[at]
        total = lambda x: np.bincount(by, weights=x, minlength=len(rows))
        return pa.table({
            id_col: rows.column("id"), "train": rows.column("train"),
            "n_tokens": np.diff(s.first) - 1, "n_known": total(c > 0).astype(np.int64), "train_tokens": np.full(len(rows), model["tokens"], np.int64),
            "base_score": total(base), "score": total(np.log10(s.probability(order)[at])),
        })

    kind = docs.schema[id_col].dataType.simpleString()
    return exchange.each_block(blocks, answers, score, f"`{id_col}` {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _counts_of_counts(kept: DataFrame, order: int) -> np.ndarray:
    """Sums of fixed size over the shards, by order: tokens, counts of counts and types."""
    n = np.zeros((order + 1, K + 3), np.int64)
    for r in kept.where(F.col("kind").between(-order, -1)).select("kind", "data").toLocalIterator():
        n[-r["kind"]] += exchange.expand(bytes(r["data"]))
    return n


def of_counts(n: np.ndarray) -> dict:
    """n[m]: [tokens, n1 .. n(K+1), types] of order m."""
    d = [discounts(x) for x in n]
    tokens, types = int(n[1][0]), int(n[1][-1])
    lost = sum(n[1][r] * r * (1 - d[1][r]) for r in range(1, K + 1))
    total = tokens + (lost <= 0)
    return {"d": d, "tokens": tokens, "types": types, "total": total, "unknown": (total - tokens + lost) / total if total else 1.0}
