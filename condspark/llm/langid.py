"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed n-grams of one to three characters over the lower-cased letters of the whole
text, other characters being one gap; their values are relative frequency times inverse
document frequency, counted over all rows that may be learnt from.  Weights are learnt by
follow-the-regularised-leader with elastic-net penalties, on a sample of about ``SAMPLE`` labelled
rows (chosen by hash of id and text; more of a label with few rows, up to ``LEAST`` of each); a part
of the sample that isn't learnt from sets the temperature of the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash

SAMPLE, LEAST = 4000, 200
BITS, ORDERS = 15, 3
UNKNOWN = "und"
PIECE = 250_000
_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _tables:
        _tables.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _tables[0]


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts as (text numbers, feature numbers, texts that have a letter).

    A long text comes in several runs; every n-gram is in exactly one.
    """
    alpha = _letters()
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush():
        of = np.concatenate([np.full(len(x), i, np.int64) for i, x in held])
        x = np.concatenate([x for _, x in held])
        return (of, x)

    for i, t in enumerate(texts):
        if not t:
            continue
        x = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        on = alpha[x]
        if not on.any():
            continue
        keep = on.copy()
        keep[1:] |= on[:-1]
        x = np.where(on, x, 32)[keep].astype(np.uint64)
        x = np.concatenate([[np.uint64(32)], x, np.full(int(x[-1] != 32), 32, np.uint64)]).astype(np.uint64)
        for a in range(0, max(1, len(x) - 1), PIECE):  # pieces overlap by what an n-gram needs
            part = x[max(0, a - (ORDERS - 1) if a else 0) : a + PIECE]
            held.append((i, part))
            size += len(part)
            if size >= PIECE:
                yield _hashed(*flush())
                held, size = [], 0
    if held:
        yield _hashed(*flush())


def _hashed(of: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    numbers, own = [], []
    code = np.zeros(len(x), np.uint64)
    for n in range(1, ORDERS + 1):
        if len(x) < n:
            break
        code = (code[: len(x) - n + 1] * np.uint64(0x9E3779B1) + x[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        same = of[: len(code)] == of[n - 1 :]
        gap = (x[: len(code)] == 32) if n == 1 else np.zeros(len(code), bool)
        on = same & ~gap
        numbers.append(((code >> np.uint64(64 - BITS)).astype(np.int64) + ((n - 1) << BITS))[on])
        own.append(of[: len(code)][on])
    return np.concatenate(own), np.concatenate(numbers), np.unique(of)


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.labels, self.weights, self.bias, self.temperature = labels, weights.astype(np.float32), bias, temperature

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(logits before calibration, whether each text has a letter)."""
        total, n = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts), np.int64)
        for of, numbers, _ in features(texts):
            edge = np.flatnonzero(np.diff(of, prepend=-1)) if len(of) else np.zeros(0, np.int64)
            for k in range(len(self.labels)):
                if len(edge):
                    np.add.at(total[:, k], of[edge], np.add.reduceat(self.weights[numbers, k], edge, dtype=np.float64))
            n += np.bincount(of, minlength=len(texts))
        return total / np.maximum(n, 1)[:, None] + self.bias, n > 0

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        logits, known = self.logits(texts)
        if not self.labels:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        p = softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        return [self.labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, p.max(axis=1), 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], df: np.ndarray, documents: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 0) -> Model:
    """rows: (feature numbers, relative frequencies) of each labelled text; df: texts with each feature, of ``documents``."""
    names = sorted(set(labels))
    if not names:
        return Model([], np.zeros((ORDERS << BITS, 0)), np.zeros(0), 1.0)
    y = np.array([names.index(v) for v in labels])
    size = ORDERS << BITS
    held = np.arange(len(rows)) % 5 == 4
    learn = np.flatnonzero(~held)
    idf = np.log((1 + documents) / (1 + df)) + 1
    # relative frequencies are small numbers: one scale for all brings the mean row norm to 1
    norms = [np.sqrt(((f * idf[j]) ** 2).sum()) for j, f in (rows[i] for i in learn)]
    scale = 1 / max(1e-9, float(np.mean(norms))) if norms else 1.0
    x = [(j, f * idf[j] * scale) for j, f in rows]
    z, n = np.zeros((size + 1, len(names))), np.zeros((size + 1, len(names)))

    def weight(j: np.ndarray) -> np.ndarray:
        shrink = np.sign(z[j]) * np.maximum(np.abs(z[j]) - l1, 0)
        return -shrink / ((beta + np.sqrt(n[j])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(learn):
            j, v = np.append(x[i][0], size), np.append(x[i][1], 1.0)
            w = weight(j)
            p = softmax((v @ w)[None])[0]
            p[y[i]] -= 1
            g = v[:, None] * p
            s = (np.sqrt(n[j] + g * g) - np.sqrt(n[j])) / alpha
            z[j] += g - s * w
            n[j] += g * g
    w = weight(np.arange(size + 1))
    bias = w[-1]
    w = w[:-1]
    test = np.flatnonzero(held)
    temperature = 1.0
    if len(test):
        logits = np.array([x[i][1] @ w[x[i][0]] + bias for i in test])
        grid = np.geomspace(0.05, 20, 120)
        loss = [-np.log(softmax(logits / t)[np.arange(len(test)), y[test]] + 1e-12).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return Model(names, w * (idf * scale)[:, None], bias, temperature)


def _counts(text: str | None) -> np.ndarray:
    total = np.zeros(ORDERS << BITS)
    for _, numbers, _ in features([text]):
        total += np.bincount(numbers, minlength=len(total))
    return total


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(texts that have each feature, texts with a letter) over all rows of a one-column table.

    A task gives one sum for each feature; what comes to the driver is as long as the features.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, has = np.zeros((ORDERS << BITS) + 1, np.int64), np.zeros(ORDERS << BITS, bool)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                has[:] = False
                for _, numbers, _ in features([text]):
                    has[numbers] = True
                df[:-1] += has
                df[-1] += has.any()
        on = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(df[on])], ["feature", "n"])

    df = np.zeros((ORDERS << BITS) + 1, np.int64)
    for r in texts.mapInArrow(wordhash.tidy(count), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        df[r["feature"]] = r["n"]
    return df[:-1], int(df[-1])


def train(docs: DataFrame, label_col: str, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, least: int = LEAST) -> Model:
    """Learn from about ``sample`` rows with a label, where ``learn`` holds (default: all; null is false).

    A label with fewer rows than others has up to ``least`` of them in the sample.  Rows of equal id and text
    count once in it.  Document frequencies are of all the rows.  Without any labelled row the
    model knows no language.
    """
    rows = docs.where(F.col(label_col).isNotNull() & F.coalesce(F.lit(True) if learn is None else learn, F.lit(False)))
    rows = rows.select(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("k"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # one row a language
    if not sizes:
        return fit([], [], np.zeros(ORDERS << BITS), 0)
    n = sum(sizes.values())
    shares = F.create_map(*[F.lit(x) for label, rows_of in sizes.items() for x in (label, int(min(1.0, max(sample / n, least / rows_of)) * 1_000_000 + 1))])
    picked = rows.where(F.pmod(F.xxhash64("k", F.lit("sample")), F.lit(1_000_000)) < shares[F.col("label")])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = _counts(text)
                on = np.flatnonzero(total)
                if len(on):
                    cells = [k], [label], [on.astype("<i4").tobytes()], [(total[on] / total.sum()).astype("<f4").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int64()), pa.array(cells[1], pa.string()), pa.array(cells[2], pa.binary()), pa.array(cells[3], pa.binary())], ["k", "label", "at", "share"])

    told = picked.mapInArrow(sparse, "k long, label string, at binary, share binary").dropDuplicates(["k", "label"])
    got = sorted((r["k"], r["label"], bytes(r["at"]), bytes(r["share"])) for r in told.collect())
    df, documents = document_frequencies(rows.select("text"))
    return fit([(np.frombuffer(a, "<i4"), np.frombuffer(s, "<f4").astype(float)) for _, _, a, s in got], [label for _, label, _, _ in got], df, documents)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, more, lang_pred, score) for every row; ``und`` and 0 where the text is null or has no letter.

    The model is as large as its features times its languages, whatever the corpus.  Texts are read whole, however long;
    repeated rows give repeated results, an empty table none; other columns are ignored.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, score = model.predict([t or "" for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(label, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[1:], "lang_pred", "score"])

    rows = docs.select(F.col(text_col).cast("string").alias("_text"), id_col, *more)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])
    return rows.mapInArrow(wordhash.tidy(predict), f"{schema}, lang_pred string, score double")


def annotate(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score added to every row, as in identify; columns of docs so named are replaced."""
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, score = model.predict([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(wordhash.tidy(predict), schema)


def accepted(docs: DataFrame, model: Model, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns and no other, whose language is known with ``least_score`` at least.

    A null text and one without letters have no language.
    """
    at = docs.columns.index(text_col)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, score = model.predict([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([name != UNKNOWN and p >= least_score for name, p in zip(label, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(wordhash.tidy(sift), docs.schema)
