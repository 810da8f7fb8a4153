"""Nearest neighbours, phrases and the manifest beside plain versions, over awkward tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, texts

from condspark.llm import exchange, merkle, phrases, prefix_forest, queries


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None, ""][i % 4], "s" if i % 5 else None, len(t or "") if i % 3 else None, 7, "c") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[7], rows[7], (None, "no id but text", "en", "s", 3, 7, "c"), (-3, "ü é", "é", "s", 2**63 - 1, 7, "c")], SCHEMA)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def cells(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_manifest(rows):
    """By whole levels, as the contract tells it."""

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    trees = collections.defaultdict(list)
    for r in rows:
        trees[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, cells([r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    low = {t: levels([x[2] for x in sorted(trees[t], key=lambda x: x[:3])]) for t in names}
    high = levels([low[t][-1][0] for t in names])
    out = []
    for k, t in enumerate(names):
        for i, (*_, leaf, r) in enumerate(sorted(trees[t], key=lambda x: x[:3])):
            way = []
            for tower, at in ((low[t], i), (high, k)):
                for nodes in tower[:-1]:
                    other = at ^ 1
                    way.append((at % 2, nodes[other] if other < len(nodes) else None))
                    at //= 2
            end = leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
                end = cells([r["doc_id"], r["source"], r["lang"], r["n_chars"] + 1, r["text"]])
            for right, other in way:
                end = h(end) if other is None else h(other, end) if right else h(end, other)
            out.append((r["doc_id"], leaf, low[t][-1][0], high[-1][0], h(*[x for _, x in way if x]), end, end == high[-1][0]))
    return out


@pytest.mark.parametrize("levels", [2, 10])
def test_manifest_beside_whole_levels(spark, docs, tmp_path, monkeypatch, levels):
    real = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda *a: real(*a, levels))  # small blocks: several rounds above them
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_merkle_manifest(spark, str(tmp_path)).collect()
    want = plain_manifest([r.asDict() for r in docs.collect()])
    assert collections.Counter(tuple(r)[:7] for r in got) == collections.Counter(want)
    assert any(r.verified for r in got) and not all(r.verified for r in got)


def test_manifest_edges(spark, docs):
    assert merkle.manifest(docs.limit(0)).count() == 0
    one = merkle.manifest(docs.where("doc_id = 3")).first()
    assert one.leaf == one.subroot == one.root and one.proof == [] and one.proof_sha256 == h("") and one.verified
    for row in merkle.manifest(docs, ["text"], "source", "doc_id").collect():
        assert merkle.folded(row.leaf, row.proof) == row.root and row.verified
    with pytest.raises(ValueError, match="place"):
        merkle.manifest(docs.withColumnRenamed("doc_id", "place"), ["text"], id_col="place")
    for n in range(1, 40):
        leaves = [str(i) for i in range(n)]
        root, proofs = merkle.traverse(leaves, merkle.height(n))
        assert all(merkle.folded(x, p) == root for x, p in zip(leaves, proofs, strict=True))
        assert merkle.folded("other", proofs[0]) != root or n == 1


def plain_phrases(rows, least, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, a in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * count[p[i : i + m]]}
        kept = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "size"), [(3, 2000, 500), (5, 20, 100_000), (2, 7, 3000)])
def test_phrases_beside_plain_counts(docs, monkeypatch, least, top, size):
    """Small shards as well: phrases whose counts come from many."""
    real = exchange.write_blocks
    monkeypatch.setattr(exchange, "write_blocks", lambda *a: real(*a, bytes_a_block=size))
    got = phrases.collocations(docs, least=least, top=top).collect()
    assert sorted(tuple(r) for r in got) == plain_phrases([(r.text, r.lang) for r in docs.collect()], least, top)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_suffix_intervals_are_counts():
    rng = np.random.default_rng(1)
    for words in (1, 2, 3, 9):
        rows = [" ".join("abcdefghi"[i] + (".", "", "\n", "")[j] for i, j in zip(rng.integers(0, words, n), rng.integers(0, 4, n), strict=True)) for n in (0, 1, 2, 3, 60, 200)]
        langs = ["x", None, "y", "x", "x", "y"]
        s = phrases.Suffixes(pa.array([*rows, None], pa.string()), [*langs, "z"])
        for size in range(1, 5):
            want = collections.Counter()
            for t, lang in zip(rows, langs, strict=True):
                for piece in re.split("[.\n]", t):
                    w = piece.split()
                    want.update((lang or "und", " ".join(w[i : i + size])) for i in range(len(w) - size + 1))
            at, count, of = s.intervals(size)
            assert {(s.langs[s.lang[a]], p): c for a, p, c in zip(at.tolist(), s.phrases(at, size).to_pylist(), count.tolist(), strict=True)} == want
            assert (of >= 0).sum() == sum(want.values())


def test_phrases_with_counts_beyond_32_bits(spark):
    """The score's product passes 64 bits."""
    a, left, right = 9_000_000_000_000, 9_000_000_000_001, 9_000_000_000_005
    d = spark.createDataFrame([("en", 2, "a b", a), ("en", 1, "a", left), ("en", 1, "b", right)], "lang string, size int, phrase string, f long")
    words = spark.createDataFrame([("en", left + right)], "lang string, n long")
    old, phrases.ngrams = phrases.ngrams, lambda *_: (d, words)
    try:
        row = phrases.collocations(d).first()
    finally:
        phrases.ngrams = old
    assert (row.score, row.l, row.r) == (2000000 * a // (left + right), left, right)


VECTORS = "vec_id long, embedding array<float>, query_row int, score string"


def test_neighbours_of_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist(), 1, "s") for i in range(300)]
    rows += [rows[20], rows[20], (None, [1.0] * 6, 1, "s"), (400, None, 1, "s"), (401, [], 1, "s"), (402, [0.0] * 6, 1, "s"), (403, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, "s")]
    rows += [(404, [float("nan")] * 6, 1, "s"), (405, [float("inf"), *[1.0] * 5], 1, "s"), (460, [3.0, 4.0], 1, "s"), (461, [1.0, 2.0], 1, "s"), (480, [1.0], 1, "s")]
    d = spark.createDataFrame(rows, VECTORS)
    got = prefix_forest.neighbours(d, F.col("vec_id") % 20 == 0, k=20)
    sound = [(i, v) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    want = collections.Counter()
    for a, (q, x) in enumerate(sound):
        if q % 20 == 0:
            found = sorted((-float(np.dot(x, y)), i) for b, (i, y) in enumerate(sound) if b != a and len(x) == len(y))
            want.update((q, rank, i, -s) for rank, (s, i) in enumerate(found[:20], 1))
    assert collections.Counter(tuple(r) for r in got.collect()) == want and want[460, 1, 461, 11.0] == 1
    assert prefix_forest.neighbours(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert prefix_forest.neighbours(d, F.lit(False)).count() == 0


def recall(got, table):
    vectors = np.array([v for _, v in table])
    ids = np.array([i for i, _ in table])
    by = collections.defaultdict(list)
    for r in got:
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = vectors @ vectors[q]
        score[q] = -np.inf
        edge = np.sort(score)[-20]
        found = sorted(by[ids[q]])
        assert [r for r, *_ in found] == list(range(1, 21))
        assert all(abs(s - vectors[np.flatnonzero(ids == i)[0]] @ vectors[q]) < 1e-12 for _, i, s in found)
        hits += sum(s >= edge - 1e-12 for *_, s in found)
        total += 20
    return hits / total


@pytest.mark.parametrize("kind", ["any", "groups", "lengths"])
def test_recall_of_neighbours(spark, kind):
    """Beside all inner products, where blocks are too large to be searched whole."""
    rng = np.random.default_rng(3)
    n = 12_000 if kind == "any" else 6000
    v = rng.standard_normal((n, 64))
    if kind == "groups":  # a third are near copies of one, and many small groups
        v[: n // 3] = v[0] + 0.1 * rng.standard_normal((n // 3, 64))
        v[n // 3 :] = v[n // 3 :][np.arange(n - n // 3) // 25 * 25] + 0.2 * rng.standard_normal((n - n // 3, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if kind == "lengths":  # the longest are near to many
        v *= rng.uniform(0.5, 2, (n, 1))
    order = rng.permutation(n)
    rows = [(int(i), x) for i, x in zip(order, v.tolist(), strict=True)]
    got = prefix_forest.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert recall(got, rows) >= 0.9
