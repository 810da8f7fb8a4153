"""Secret scanning: fixed patterns, and strings that a primed compressor finds new.

Three patterns give the base spans.  Beyond them, every string of six characters or more shortly
after a sensitive word is a candidate, as six are what the first pattern asks of a value.
Zstandard is primed with a dictionary of words and identifiers and the text around it; the bytes
that the candidate adds to the compressed context measure how new it is, and they alone decide.
Words, names, paths and repeated strings add little; random strings nearly all of their content.
A string made of plain words and short numbers has to add a larger share of its length (``PLAIN_NEW``)
than one of mixed characters (``NEW``), and all have to add ``LEAST`` bytes: below, whole
bytes can't tell a random string from a rare word, so most random ones of six or seven characters stay.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
#: Words that make what follows sensitive.
SENSITIVE = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api key", "credential", "private key", "access key", "bearer", "authorization", "auth_"]
_AFTER = re.compile("|".join(SENSITIVE), re.ASCII | re.IGNORECASE)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~.-]{6,}")
#: Identifiers and phrases as they stand around secrets in code and configuration.
IDENTIFIERS = [
    "import os from sys class def return self public static final void string const let var function async await",
    "password passwd username user_name login secret token access_token refresh_token client_id client_secret api_key apikey",
    "authorization bearer basic credential private_key public_key BEGIN RSA PRIVATE KEY END CERTIFICATE ssh-rsa",
    "export environment config settings default database host port url http https www com org net json yaml xml html",
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef",
    "get_value set_value file_name path_name first_name last_name created_at updated_at example placeholder changeme",
    "1.0.0 2.0.1 v1.2.3 127.0.0.1 192.168.0.1 utf-8 UTF-8 sha256 base64 .py .txt .json .html .php",
    " ".join(f"{y}-{m:02d}-" for y in range(1990, 2040) for m in range(1, 13)),
]
#: The words of this vocabulary go before them, the most frequent last.
VOCABULARY = "byte_bpe_50k.json"
#: Letters as frequent as in identifiers, but in no known order: goes before every context, so that
#: single characters cost alike however short the text is.
BACKGROUND = " ".join(w[::-1] for w in " ".join(IDENTIFIERS[:4]).split()) + "\n"
_PARTS = re.compile(r"[_.\-/+=~]+|(?<=[a-z])(?=[A-Z])")
_PLAIN = re.compile(r"[A-Za-z][a-z]*|[A-Z]+|[0-9]{0,4}")
REACH, AROUND, NEW, PLAIN_NEW, LEAST = 48, 400, 0.55, 0.65, 8
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[*range(48, 58), *range(97, 103)]] = True


def marginal_bytes(context: str, candidate: str, primed: zstandard.ZstdCompressor) -> int:
    """Bytes that the candidate adds to the compressed context."""
    a = context.encode()
    return len(primed.compress(a + candidate.encode())) - len(primed.compress(a))


@functools.cache
def _primed() -> zstandard.ZstdCompressor:
    with open(public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        rank = json.load(f)["model"]["vocab"]
    known = [w[1:] for w in sorted(rank, key=rank.get, reverse=True) if re.fullmatch("\u0120[A-Za-z]{3,}", w)]
    words = zstandard.ZstdCompressionDict("\n".join([" ".join(known), *IDENTIFIERS]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(level=19)
    return zstandard.ZstdCompressor(level=19, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def novel_spans(text: str, base: list[tuple[int, int, int]], primed: zstandard.ZstdCompressor) -> list[tuple[int, int, int]]:
    """Incompressible strings within REACH characters after a sensitive word that no base span touches."""
    out, until = [], 0
    for word in _AFTER.finditer(text):
        for m in _CANDIDATE.finditer(text, max(until, word.end()), min(len(text), word.end() + REACH + 256)):
            if m.start() > word.end() + REACH:
                break
            end = m.end()
            while end < len(text) and _CANDIDATE.match(text[end] * 16):  # the window may have cut it
                end += 1
            until = end
            found = text[m.start() : end]
            if any(s < end and m.start() < e for s, _, e in base):
                continue
            share = PLAIN_NEW if all(_PLAIN.fullmatch(p) for p in _PARTS.split(found)) else NEW
            # what stands around it, without it
            around = text[max(0, m.start() - AROUND) : m.start()]
            context = BACKGROUND + text[end : end + AROUND] + "\n" + around
            if marginal_bytes(context, found, primed) >= max(LEAST, share * len(found)):
                out.append((m.start(), 3, end))
    return out


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _suspects(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Texts that may hold a span: a long hexadecimal run, an access id or a sensitive word."""
    offsets, raw = wordhash.string_buffers(column)
    texts = [t or "" for t in column.to_pylist()]
    flag = np.zeros(len(texts), bool)
    for i, t in enumerate(texts):
        low = t.lower()
        flag[i] = "AKIA" in t or any(w in low for w in SENSITIVE)
    lo, hi = int(offsets[0]), int(offsets[-1])
    for a in range(lo, hi, 1 << 22):
        on = _HEX_BYTE[raw[a : min(hi, a + (1 << 22) + 24)]]
        begin, finish = on.copy(), on.copy()
        begin[1:] &= ~on[:-1]
        finish[:-1] &= ~on[1:]
        # a run ends where its text ends, whatever the next text begins with
        borders = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, a + len(on))] - a
        begin[borders] = on[borders]
        before = borders[borders > 0] - 1
        finish[before] = on[before]
        first, last = np.flatnonzero(begin), np.flatnonzero(finish)
        flag[np.searchsorted(offsets, first[last - first >= 23] + a, "right") - 1] = True
    return flag, texts


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, n_novel, base, spans), a row for each row of docs.

    base and spans list kind:start:end in code points, end exclusive, by start, then kind.  A null
    text is empty and has none; repeated rows give repeated results, an empty table none.  A very long text is read whole;
    other columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        primed = _primed()
        for batch in batches:
            flag, texts = _suspects(batch.column(1))
            counts = np.zeros((4, len(texts)), np.int64)
            base, every = [""] * len(texts), [""] * len(texts)
            for i in np.flatnonzero(flag).tolist():
                spans = base_spans(texts[i])
                more = novel_spans(texts[i], spans, primed)
                base[i], every[i] = said(spans), said(sorted(spans + more))
                for _, k, _ in spans + more:
                    counts[k, i] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(base, pa.string()), pa.array(every, pa.string())], [id_col, *(f"n_{k}" for k in KINDS), "base", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(wordhash.tidy(scan), f"`{id_col}` {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base string, spans string")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every span of its text replaced by ``mark``; overlapping spans become one."""
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        primed = _primed()
        for batch in batches:
            flag, texts = _suspects(batch.column(at))
            for i in np.flatnonzero(flag).tolist():
                t = texts[i]
                base = base_spans(t)
                parts, last = [], 0
                for s, _, e in sorted(base + novel_spans(t, base, primed)):
                    if s >= last:
                        parts += [t[last:s], mark]
                    last = max(last, e)
                texts[i] = "".join([*parts, t[last:]])
            given = batch.column(at)
            new = pa.array([None if v else t for v, t in zip(given.is_null().to_pylist(), texts, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(wordhash.tidy(clean), docs.schema)
