"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text's k-mers (runs of ``K`` words, lower-cased ASCII) are labelled with their occurrence
number.  For each of ``BANDS`` hash functions the ``L`` least labelled k-mers are taken and kept in
text order, so two texts agree with a probability that falls with their edit distance and not
only with their sets.  Texts that agree in one such sketch share a bucket and are candidates.

Texts of equal words are one node.  Each node of a bucket is first compared with the one that meets
most others in all buckets: with a base text and its copies that is the base.  Where a bucket still
holds several components, all pairs of its nodes in different ones are compared, but for those that
lengths or word parities rule out; both filters are exact, so no such pair is lost.

A link is verified by aligning the word sequences within the band of diagonals that the threshold
allows: aligned words over the words of the longer text must be at least the threshold.
Components, links and fingerprints stay distributed.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange, scratch, wordhash

#: With two k-mers in each of 48 sketches a pair of similarity 0.8, a fifth of whose words are replaced, is met with 0.85.
K, L, BANDS = 5, 2, 48
THRESHOLD = 0.8
BITS, COARSE = 8192, 1024
_TOP = np.iinfo(np.uint64).max


def _labelled(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labelled k-mers of all texts, where each text's begin); texts below K words have none."""
    n = np.maximum(np.diff(first) - K + 1, 0)
    starts = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(starts[-1]) + np.repeat(first[:-1] - starts[:-1], n)
    kmers = wordhash.windows(h, K)[at] if len(at) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(n)), n).astype(np.uint64)
    key = kmers ^ wordhash.mix(doc + np.uint64(1))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    runs = np.flatnonzero(new)
    occurrence = np.empty(len(order), np.uint64)
    occurrence[order] = (np.arange(len(order)) - np.repeat(runs, np.diff(np.append(runs, len(order))))).astype(np.uint64)
    return wordhash.mix(kmers + occurrence * np.uint64(0x9E3779B97F4A7C15)), starts


def sketches(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Band keys (texts x BANDS) of texts with k-mers; 0 for the others."""
    kmers, starts = _labelled(h, first)
    n = np.diff(starts)
    docs = np.flatnonzero(n)
    out = np.zeros((len(n), BANDS), np.uint64)
    if not len(docs):
        return out
    count = n[docs]
    of = np.repeat(np.arange(len(docs)), count)
    limit = np.where(count <= 32, _TOP, (_TOP // np.maximum(count, 1).astype(np.uint64)) * np.uint64(16))
    need = np.minimum(count, L)
    per_kmer = limit[of]
    for j, seed in enumerate(wordhash.mix(np.arange(1, BANDS + 1, dtype=np.uint64)) | np.uint64(1)):
        value = kmers * seed
        # only values small enough to be among the least; texts left with too few take all
        on = np.flatnonzero(value <= per_kmer)
        got = np.bincount(of[on], minlength=len(docs))
        short = np.flatnonzero(got < need)
        if len(short):
            wide = limit.copy()
            wide[short] = _TOP
            on = np.flatnonzero(value <= wide[of])
            got = np.bincount(of[on], minlength=len(docs))
        v, own = value[on], of[on]
        begin = np.cumsum(got) - got
        places = np.empty((L, len(docs)), np.int64)
        for i in range(L):
            least = np.minimum.reduceat(v, begin)
            hit = np.flatnonzero(v == least[own])
            # texts of fewer k-mers have their last one again
            places[i] = places[i - 1] if i else 0
            at = hit[count[own[hit]] > i]
            places[i, own[at]] = on[at]
            v[hit] = _TOP
        band = np.full(len(docs), j + 1, np.uint64)
        for place in np.sort(places, axis=0):
            band = wordhash.mix(band * np.uint64(0x9E3779B97F4A7C15) + kmers[place])
        out[docs, j] = band | np.uint64(1)
    return out


def _needed(n: int, m: int, threshold: float) -> int:
    return math.ceil(threshold * max(n, m) - 1e-9)


def aligned_words(a: np.ndarray, b: np.ndarray, need: int) -> int:
    """Most words of a and b that can be aligned in order, if they are ``need`` or more; else 0.

    Only diagonals that leave at most len - need words of either text unaligned are looked at.  A row
    of the table is one integer, whose zero bits count the aligned words so far, so a word of b
    costs a few operations on len(a) bits.
    """
    n = min(len(a), len(b))
    head = int(np.argmin(np.append(a[:n] == b[:n], False)))
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    tail = int(np.argmin(np.append(a[::-1][:n] == b[::-1][:n], False)))
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    rest, n, m = need - head - tail, len(a), len(b)
    if rest > min(n, m):
        return 0
    # an alignment of ``rest`` words leaves at most n - rest of a and m - rest of b out
    over, under = (n - rest, m - rest) if rest > 0 else (n, m)
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    row = whole = (1 << n) - 1
    band = (1 << (over + under + 1)) - 1
    for j, w in enumerate(b):
        if match := where.get(w):
            match &= band << (j - under) if j >= under else band >> (under - j)
            up = row & match
            row = ((row + up) | (row - up)) & whole
        if j & 255 == 255 and n - row.bit_count() + m - j - 1 < rest:
            return 0
    found = n - row.bit_count() + head + tail
    return found if found >= need else 0


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Aligned words over the words of the longer text; 0 where that is below the threshold."""
    n, m = len(a), len(b)
    need = _needed(n, m, threshold)
    if not need or min(n, m) < need:
        return 0.0
    if n == m and (a == b).all():
        return 1.0
    # common words with repeats: no alignment has more
    ux, cx = np.unique(a, return_counts=True)
    uy, cy = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(uy, ux), len(uy) - 1)
    if int(np.minimum(cx, cy[at])[uy[at] == ux].sum()) < need:
        return 0.0
    return aligned_words(a, b, need) / max(n, m)


def _verify(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """The distinct pairs (a, b, end_a, end_b) whose texts are alike, as a written table of their ends."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("words_a").to_pylist(), batch.column("words_b").to_pylist()
            ok = [similarity(exchange.expand(p), exchange.expand(q), threshold) >= threshold for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("end_a", "end_b")], ["a", "b"])

    side = lambda c: words.select(F.col("node").alias(c), F.col("n_words").alias(f"n_{c}"), F.col("words").alias(f"words_{c}"))
    # dealt by b once, for the distinct pairs and the first join: a leader (a) has many, a node few leaders;
    # the join by a is a plain shuffle on both sides, which is split where a leader is hot
    both = pairs.repartition("b").distinct().join(side("b"), "b").join(side("a"), "a").where(f"least(n_a, n_b) >= {threshold}D * greatest(n_a, n_b) - 1e-6D")
    return scratch.table(both.select("end_a", "end_b", "words_a", "words_b").mapInArrow(wordhash.tidy(check), "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node with a link; comp is one of the component's nodes.

    Each round every node goes over to its least neighbour, if that is less, and the links between
    different nodes that remain are a smaller graph; the rounds' steps are joined up.  Nodes are ordered by
    a hash, anew each round, so that no numbering of a long chain makes as many rounds as it has nodes.
    """
    edges, found = links.select("a", "b").where("a <> b"), None
    for turn in itertools.count():
        place = lambda c, turn=turn: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("n"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.min(place("b")).alias("m")).select("node", F.least("m", place("node"))["n"].alias("comp")), "step")
        if found is None:
            labels = step
        else:
            far = step.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
            labels = scratch.table(found.join(far, "comp", "left").select("node", F.coalesce("far", "comp").alias("comp")), "labels")
        to = lambda c: step.select(F.col("node").alias(c), F.col("comp").alias(f"to_{c}"))
        left = edges.join(to("a"), "a").join(to("b"), "b").where("to_a <> to_b")
        left = scratch.table(left.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        if found is not None:
            scratch.drop(edges, step, found)
        edges, found = left, labels
        if edges.isEmpty():
            scratch.drop(edges)
            return found


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, node, comp, main) of buckets that hold several components; main is the largest."""
    known = members.select("bucket", "node").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")).repartition("bucket").distinct()
    sizes = known.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    return scratch.table(known.join(main.select("bucket", "main"), "bucket"), "open")


def parities(words: np.ndarray) -> np.ndarray:
    """BITS bits, each telling whether an odd number of the text's words, by occurrence, falls to it.

    Bits that differ between two texts are at most as many as the words that only one of them has.
    """
    keys, times = np.unique(words.astype(np.uint64), return_counts=True)
    nth = np.arange(len(words)) - np.repeat(np.cumsum(times) - times, times)
    word = wordhash.mix(np.repeat(keys, times) * np.uint64(0x9E3779B97F4A7C15) + nth.astype(np.uint64))
    odd = np.bincount((word % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _rest(open_: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, end_a, end_b) of a bucket in different components that can reach the threshold, as a written table.

    Nodes outside a bucket's largest component meet those of its nodes whose lengths are in the same class or the nearer
    neighbouring one, half a class being as wide as the threshold lets lengths differ.  Lengths and parities (folded to
    COARSE bits first, which are told by plain arithmetic) then rule out all but near pairs, and of the buckets that a pair shares only one tells it.  end_a is a's
    component.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [parities(exchange.expand(x)) for x in batch.column("words").to_pylist()]
            # a word's bit among fewer is its bit's place by their number, so parts fold onto each other
            coarse = [np.bitwise_xor.reduce(x.reshape(-1, COARSE // 64), axis=0) for x in bits]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (bits, coarse)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n_words"), batch.column("buckets"), *lists], ["node", "n_words", "buckets", "bits", "coarse"])

    nodes = open_.groupBy("node").agg(F.collect_set("bucket").alias("buckets")).join(words.select("node", "n_words", "words"), "node")
    marked = nodes.select("node", "n_words", "buckets", "words").mapInArrow(wordhash.tidy(mark), "node long, n_words long, buckets array<long>, bits array<long>, coarse array<long>")
    width = -math.log(threshold) + 1e-6
    step = F.log(F.col("n_words")) / (2 * width)
    rows = open_.join(marked, "node").withColumn("size", F.floor(step))
    rows = scratch.table(rows, "marked")
    outside = rows.where("comp <> main").select("bucket", F.explode(F.array(F.floor(step - 0.5), F.floor(step + 0.5))).alias("size"), F.struct("node", "comp", "n_words", "buckets", "bits", "coarse").alias("s"))
    apart = f"n_words + s.n_words - {2 * threshold}D * greatest(n_words, s.n_words) + 1e-6D"
    roughly = F.expr(" + ".join(f"bit_count(coarse[{i}] ^ s.coarse[{i}])" for i in range(COARSE // 64)) + f" <= {apart}")
    differ = F.expr(f"aggregate(zip_with(bits, s.bits, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x) <= {apart}")
    near = F.expr(f"comp <> s.comp and least(n_words, s.n_words) >= {threshold}D * greatest(n_words, s.n_words) - 1e-6D")
    once = F.expr("bucket = array_min(array_intersect(buckets, s.buckets))")
    met = rows.join(outside, ["bucket", "size"]).where(near & roughly & differ & once)
    first, last = F.struct("node", "comp"), F.struct(F.col("s.node").alias("node"), F.col("s.comp").alias("comp"))
    pair = met.select(F.least(first, last).alias("p"), F.greatest(first, last).alias("q"))
    # written: few pairs are left, and word sequences need not be dealt out to meet them
    found = scratch.table(pair.select(F.col("p.node").alias("a"), F.col("q.node").alias("b"), F.col("p.comp").alias("end_a"), F.col("q.comp").alias("end_b")), "rest")
    scratch.drop(rows)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, block, place, node, class_id, class_size, is_first): a row for each row of docs.

    Rows of one class have equal words or are linked, in steps, by a similarity of at least threshold:
    aligned words over the words of the longer text.
    class_id is a hash of words of one of its texts.  Texts below K words, empty and null ones
    included, are classes with their equals only, but texts without words are each alone (class_id is
    then made of the row's place).  is_first marks one row of each class: the least by id, then
    place (nulls last).  Texts are told apart by 64-bit hashes of their words.  A very long text is one block; an empty table
    gives no rows; repeated rows are one class; other columns are ignored.
    """
    out = _classes(exchange.write_blocks(docs, id_col, text_col), threshold, last=True)
    return out.select(F.col("id").alias(id_col), *out.columns[1:])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The first row of each class of near duplicates, with all columns of docs."""
    more = [c for c in docs.columns if c not in (id_col, text_col)]
    blocks = exchange.write_blocks(docs, id_col, text_col, {f"more{i}": F.col(f"`{c}`") for i, c in enumerate(more)})
    classed = _classes(blocks.select("block", "place", "id", "text"), threshold)
    # written, dealt like the blocks, so that of all that was made on the way only these two stay with the result
    first = scratch.table(exchange.by_block(classed.where("is_first").select("block", "place")), "first", "block")
    scratch.drop(classed)

    def take(rows: pa.Table, places: pa.Table) -> pa.Table:
        rows = exchange.in_order(rows).take(pa.array(np.sort(places.column("place").to_numpy())))
        return rows.drop_columns(["block", "place"])

    schema = T.StructType([f for f in blocks.schema.fields if f.name not in ("block", "place")])
    kept = blocks.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(take, schema)
    names = {id_col: "id", text_col: "text"} | {c: f"more{i}" for i, c in enumerate(more)}
    return kept.select(*[F.col(names[c]).alias(c) for c in docs.columns])


def _shared(sketched: DataFrame) -> DataFrame:
    """(node, bucket) of the buckets that two rows of sketched (block, node, bands) or more hold, as a written table.

    Most buckets are one text's alone.  Blocks ask for their distinct ones, sorted and packed, how many hold them in all; so
    alone these numbers move, and not a row for each bucket of each text.
    """
    shards = scratch.partitions(sketched.sparkSession)

    def keys_of(rows: pa.Table) -> np.ndarray:
        return rows.column("bands").combine_chunks().flatten().to_numpy().view(np.uint64)

    def ask(block: int, rows: pa.Table, _: dict) -> list[dict]:
        keys, times = np.unique(keys_of(rows), return_counts=True)
        return exchange.questions(block, 0, keys, np.minimum(times, 2).astype(np.uint8), shards)

    def several(kind, keys: np.ndarray, times: np.ndarray, rank, inverse: np.ndarray) -> np.ndarray:
        return (np.bincount(inverse, times, len(keys)) > 1)[inverse].astype(np.uint8)

    def take(block: int, rows: pa.Table, answers: dict[int, np.ndarray]) -> pa.Table:
        keys = keys_of(rows)
        on = np.flatnonzero(answers[0][np.unique(keys, return_inverse=True)[1]]) if len(keys) else np.zeros(0, np.int64)
        return pa.table({"node": rows.column("node").take(pa.array(on // BANDS)), "bucket": pa.array(keys[on].view(np.int64))})

    told = exchange.by_block(exchange.replies(exchange.ask(sketched, None, ask), several))
    return scratch.table(exchange.each_block(sketched, told, take, "node long, bucket long"), "shared")


def _classes(blocks: DataFrame, threshold: float, last: bool = False) -> DataFrame:
    """last: nothing else reads blocks, so they go once word sequences are taken from them."""
    kind = blocks.schema["id"].dataType.simpleString()

    def sketch(block: int, rows: pa.Table, _: dict) -> pa.Table:
        h, _, _, first, _ = wordhash.words(rows.column("text"), lower=True)
        n = np.diff(first)
        node = np.zeros(len(n), np.uint64)
        power = np.uint64(0x9E3779B97F4A7C15)
        filled = np.flatnonzero(n)
        if len(filled):
            place = (np.arange(len(h)) - np.repeat(first[:-1], n)).astype(np.uint64)
            node[filled] = np.add.reduceat(wordhash.mix(h ^ wordhash.mix(place * power + np.uint64(7))), first[:-1][filled])
        node = wordhash.mix(node + n.astype(np.uint64))
        node[n == 0] = wordless(block, np.flatnonzero(n == 0))
        bands = sketches(h, first)
        on = np.zeros(len(n), bool)
        on[np.unique(node, return_index=True)[1]] = True  # equal texts of a block bring one sketch
        on &= bands[:, 0] != 0
        keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(on * BANDS)]).astype(np.int32)), pa.array(bands[on].ravel().view(np.int64)))
        return pa.table({"id": rows.column("id"), "block": pa.array(np.full(len(n), block)), "place": rows.column("place"), "node": pa.array(node.view(np.int64)), "bands": keys})

    # written by block, as their questions are asked and answered by block
    every = scratch.table(exchange.each_block(blocks, None, sketch, f"id {kind}, block long, place long, node long, bands array<long>"), "sketch", "block")
    # equal texts of a block bring one sketch, so a text comes at most once from each block
    has = F.size("bands") > 0
    in_bands = _shared(every.where(has).select("block", "node", "bands"))
    # sketches are most of what is written for a row, and from here on nothing reads them
    rows = scratch.table(every.select("id", "block", "place", "node", has.alias("sketched")), "nodes")
    scratch.drop(every)
    size = in_bands.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n")).where("least < most")
    members = scratch.table(in_bands.join(size.select("bucket", "n"), "bucket"), "members")
    scratch.drop(in_bands)
    # word sequences of candidates alone, taken from the blocks that hold them
    central = members.groupBy("node").agg(F.sum("n").alias("central"))
    at = rows.where("sketched").select("node", "block", "place").join(central, "node").groupBy("node").agg(F.min(F.struct("block", "place")).alias("at"), F.max("central").alias("central"))
    at = scratch.table(at.select("at.block", "at.place", "node", "central"), "wanted")
    wanted = exchange.by_block(at.select("block", "place", "node"))

    def sequences(key, texts: pa.Table, want: pa.Table) -> pa.Table:
        places = want.column("place").to_numpy()
        order = np.argsort(places)
        if not len(order):
            return pa.table({"node": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "words": pa.array([], pa.binary())})
        h, _, _, first, _ = wordhash.words(exchange.in_order(texts).column("text").combine_chunks().take(pa.array(places[order])), lower=True)
        blobs = [exchange.squeeze((h[a:b] >> np.uint64(32)).astype("<u4")) for a, b in zip(first[:-1], first[1:], strict=True)]
        return pa.table({"node": want.column("node").take(pa.array(order)), "n_words": pa.array(np.diff(first)), "words": pa.array(blobs, pa.binary())})

    words = scratch.table(blocks.select("block", "place", "text").groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(wordhash.tidied(sequences), "node long, n_words long, words binary"), "words")
    if last:
        scratch.drop(blocks)
    known = members.select("bucket", "node").join(at.select("node", "central"), "node").repartition("bucket")
    lead = known.groupBy("bucket").agg(F.max_by("node", F.struct("central", "node")).alias("lead"))
    star = known.join(lead, "bucket").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"), F.col("lead").alias("end_a"), F.col("node").alias("end_b"))
    links = _verify(star, words, threshold)
    scratch.drop(at)
    labels = components(links)
    open_ = _open(members, labels)
    scratch.drop(links, members)
    rest = _rest(open_, words, threshold)
    scratch.drop(open_)
    more = _verify(rest, words, threshold)
    scratch.drop(rest, words)
    if not more.isEmpty():
        near, far = labels, components(more)
        ends = near.unionByName(far.select("node", F.col("node").alias("comp")).join(near.select("node"), "node", "left_anti"))
        labels = scratch.table(ends.join(far.select(F.col("node").alias("comp"), F.col("comp").alias("far")), "comp", "left").select("node", F.coalesce("far", "comp").alias("comp")), "labels")
        scratch.drop(near, far)
    scratch.drop(more)
    classed = rows.join(labels, "node", "left").select("id", "block", "place", "node", F.coalesce("comp", "node").alias("class_id"))
    classed = scratch.table(classed, "classed")
    scratch.drop(rows, labels)
    size = classed.groupBy("class_id").agg(F.count("*").alias("class_size"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "block", "place")).alias("lead"))
    # written, so that both sides of the join are plain shuffles and a large class can be split
    out = classed.join(scratch.table(size, "classes"), "class_id")
    return out.select("id", "block", "place", "node", "class_id", "class_size", ((F.col("lead.block") == F.col("block")) & (F.col("lead.place") == F.col("place"))).alias("is_first"))


def wordless(block: int, places: np.ndarray) -> np.ndarray:
    """Nodes of texts without words: each its own, whatever the number of its block (partition and run in it)."""
    return wordhash.mix(wordhash.mix(np.full(len(places), block, np.uint64)) + places.astype(np.uint64))
