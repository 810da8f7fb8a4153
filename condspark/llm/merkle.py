"""Merkle dataset manifest: a digest of every row, of every tree of rows and of the whole, with proofs.

Rows are leaves.  The leaves of one tree (a language, say) ascend by their id and are hashed in pairs,
level by level, until one digest is left, the tree's root; a lone last node is hashed alone.  The roots of all
trees, in the order of their names, are hashed in pairs likewise, down to one root of the dataset.

A tree is cut into aligned blocks of 2 ** ``LEVELS`` leaves.  A block is walked in postorder by a recursive
function: it returns a subtree's digest and, while unwinding, appends each half's digest to the
leaves of the other half as their sibling.  The blocks' digests are the leaves of another such traversal, until each
tree is one block, so a proof is a block's own siblings and then those of the block above.  No task holds
more than a block, whatever a tree's size; places of leaves are sums over ranges, so a tree that holds most
rows is spread like many small ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch

LEVELS = 10
LEFT, RIGHT = "<", ">"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value: Column) -> Column:
    """``-`` for a null, else the count of its UTF-8 bytes, ``:`` and the value as text."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)).cast("binary"), 256)


def height(n: int) -> int:
    """Levels above n leaves until one node is left."""
    return max(0, n - 1).bit_length()


def traverse(leaves: list[str], levels: int) -> tuple[str, list[list[str]]]:
    """(digest ``levels`` above the leaves, each leaf's siblings from below, with their side; "" where alone)."""
    found: list[list[str]] = [[] for _ in leaves]

    def visit(low: int, level: int) -> str:
        if not level:
            return leaves[low]
        middle = low + (1 << level - 1)
        left = visit(low, level - 1)
        if middle >= len(leaves):
            for path in found[low:middle]:
                path.append("")
            return digest(left)
        right = visit(middle, level - 1)
        for path in found[low:middle]:
            path.append(RIGHT + right)
        for path in found[middle : middle + (1 << level - 1)]:
            path.append(LEFT + left)
        return digest(left + right)

    return visit(0, levels), found


def folded(leaf: str, proof: list[str]) -> str:
    """The root that a leaf leads to by its siblings; a proof holds if that is the root known."""
    for sibling in proof:
        leaf = digest(leaf + sibling[1:] if sibling[:1] == RIGHT else sibling[1:] + leaf)
    return leaf


def _placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with pos, a row's place in its tree by ``keys``, and n, the tree's number of rows."""
    ordered = rows.repartitionByRange(scratch.partitions(rows.sparkSession), "tree", *keys).sortWithinPartitions("tree", *keys)
    at = scratch.table(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ordered")
    whole = W.partitionBy("tree")  # as many rows a tree as there are ranges
    runs = at.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("many"))
    runs = runs.select("tree", "part", (F.sum("many").over(whole.orderBy("part")) - F.col("many") - F.col("first")).alias("shift"), F.sum("many").over(whole).alias("n"))
    return at.join(runs, ["tree", "part"]).select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "n")


_NODE = "tree string, pos long, n long, digest string"


def _block(levels: int) -> Column:
    return F.expr(f"pos div {1 << levels}").alias("block")


def _sorted(rows: pa.Table, most: int) -> tuple[pa.Table, int]:
    """A block's rows by place, and the levels that it has to climb."""
    return rows.sort_by("pos").combine_chunks(), min(most, height(rows.column("n")[0].as_py()))


def _roots(nodes: DataFrame, most: int) -> DataFrame:
    """A node for each block of nodes (tree, pos, n, digest), written."""

    def root(rows: pa.Table) -> pa.Table:
        rows, levels = _sorted(rows, most)
        block, n = rows.column("pos")[0].as_py() >> most, rows.column("n")[0].as_py()
        return pa.table({"tree": rows.column("tree")[:1], "pos": [block], "n": [-(-n >> most)], "digest": [traverse(rows.column("digest").to_pylist(), levels)[0]]})

    return scratch.table(nodes.select("tree", "pos", "n", "digest").groupBy("tree", _block(most)).applyInArrow(root, _NODE), "roots")


def _above(blocks: DataFrame, most: int) -> DataFrame:
    """(tree, pos, root, path) of each of the nodes: its tree's root and the siblings on the way there."""
    if blocks.where("n > 1").isEmpty():
        return blocks.select("tree", "pos", F.col("digest").alias("root"), F.array().cast("array<string>").alias("path"))

    def unwound(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, levels = _sorted(rows, most)
        rest = above.column("path")[0].as_py()
        paths = [own + rest for own in traverse(rows.column("digest").to_pylist(), levels)[1]]
        root = above.column("root")[0].as_py()
        return pa.table({"tree": rows.column("tree"), "pos": rows.column("pos"), "root": pa.array([root] * len(paths), pa.string()), "path": pa.array(paths, pa.list_(pa.string()))})

    below = blocks.groupBy("tree", _block(most))
    found = below.cogroup(_above(_roots(blocks, most), most).groupBy("tree", F.col("pos").alias("block"))).applyInArrow(unwound, "tree string, pos long, root string, path array<string>")
    return scratch.table(found, "paths")


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), tree_col: str = "lang", id_col: str = "doc_id", claimed: Column | None = None, most: int = LEVELS) -> DataFrame:
    """(id_col, tree_col, place, leaf, subroot, root, proof, proof_sha256, folded_root, verified): a row for each of docs.

    leaf is the SHA-256 of ``columns``, each with its length, so no two rows of different values share their text
    and a null differs from an empty text.  Trees are parted by tree_col (null is one of its own, before
    all) and ascend by id_col (nulls first), then leaf, so equal rows stand side by side and each has its own proof.
    proof: siblings from the leaf to the dataset's root, "<" or ">" before them telling their side, "" where a
    node stood alone; proof_sha256 is of the siblings joined.  ``claimed``: a leaf that someone else claims for the
    row (null: the row's own); folded_root is what that leads to with the row's proof, verified whether it is the root.
    A text of any length moves once, as its digest.  An empty table gives no rows.  Columns beside those named
    are ignored; ``most`` is the height of a block; id_col and tree_col can't have the name of a column returned.
    """
    given = ["place", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"]
    if clash := {id_col, tree_col} & set(given):
        raise ValueError(f"a column of the manifest has the name {sorted(clash)[0]}")
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id_col, tree_col)}
    own = leaf_of([F.col(f"`{c}`") for c in columns])
    name = F.when(F.col(f"`{tree_col}`").isNull(), "").otherwise(F.concat(F.lit("="), F.col(f"`{tree_col}`").cast("string")))
    light = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{tree_col}`").alias("named"), name.alias("tree"), own.alias("digest"), (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"), F.monotonically_increasing_id().alias("row"))
    leaves = scratch.table(_placed(scratch.table(light, "leaves"), ["id", "digest", "row"]), "placed")
    above = _above(_roots(leaves, most), most)
    # the roots of all trees are the leaves of one more
    roots = above.groupBy("tree").agg(F.min("root").alias("digest"))
    tops = _placed(scratch.table(roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), "trees"), ["of"])
    tops = scratch.table(tops, "tops")
    way = tops.join(_above(tops.select("tree", "pos", "n", "digest"), most).select("pos", F.col("root").alias("top"), F.col("path").alias("rest")), "pos").select(F.col("of").alias("tree"), "top", "rest")
    whole = above.join(way, "tree").select("tree", F.col("pos").alias("block"), "root", "top", F.concat("path", "rest").alias("path"))

    def told(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, levels = _sorted(rows, most)
        digests, rest = rows.column("digest").to_pylist(), above.column("path")[0].as_py()
        subroot, root = above.column("root")[0].as_py(), above.column("top")[0].as_py()
        proofs = [own + rest for own in traverse(digests, levels)[1]]
        ends = [folded(c or d, p) for c, d, p in zip(rows.column("claimed").to_pylist(), digests, proofs, strict=True)]
        same = lambda v: pa.array([v] * len(ends), pa.string())
        return pa.table({
            "id": rows.column("id"), "named": rows.column("named"), "place": rows.column("pos"), "leaf": rows.column("digest"), "subroot": same(subroot), "root": same(root),
            "proof": pa.array(proofs, pa.list_(pa.string())), "proof_sha256": [digest("".join(s[1:] for s in p)) for p in proofs], "folded_root": ends, "verified": [e == root for e in ends],
        })

    schema = f"id {kinds[id_col]}, named {kinds[tree_col]}, place long, leaf string, subroot string, root string, proof array<string>, proof_sha256 string, folded_root string, verified boolean"
    out = leaves.groupBy("tree", _block(most)).cogroup(whole.groupBy("tree", "block")).applyInArrow(told, schema)
    return out.select(F.col("id").alias(id_col), F.col("named").alias(tree_col), *given)
