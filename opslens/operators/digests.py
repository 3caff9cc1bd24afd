"""Reconciliation by a tree of digests: only key ranges that differ are looked at row by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.exprs import row_digest
from opslens.operators.sync import reconcile_rows

#: Bits of a key's hash that name a leaf, and bits that a level of the tree adds. A leaf is a range of hashes.
LEAF_BITS, LEVEL_BITS = 16, 4
MOST_BITS = 20


def leaf_of(keys: Sequence[str], bits: int = LEAF_BITS) -> Column:
    """The leaf of a row: the first bits of its key's hash; a null key has a hash like any other."""
    return F.shiftrightunsigned(F.xxhash64(*[F.struct(k) for k in keys]), 64 - bits).cast("int")


def tree(rows: DataFrame, keys: Sequence[str], cols: Sequence[str], bits: int = LEAF_BITS) -> DataFrame:
    """level, node, rows, digest: the digest tree of a table. Level 0 is the root, the last level holds the leaves.

    A digest is the sum of the digests of all rows below, keys included, so copies count and order does not. Rows are read once and combined before the
    shuffle; a tree has fewer than 2 ** (bits + 1) rows, whatever the table. Equal subtrees have equal digests. Empty nodes are left out.
    Write it once for a side that does not change, and compare as often as wanted.
    """
    if not 0 < bits <= MOST_BITS or bits % LEVEL_BITS:
        raise ValueError(f"bits are a multiple of {LEVEL_BITS}, {MOST_BITS} at most")
    leaves = rows.groupBy(leaf_of(keys, bits).alias("leaf")).agg(F.count("*").alias("rows"), F.sum(row_digest([*keys, *cols])).alias("digest"))
    steps = F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright("leaf", bits - LEVEL_BITS * level).alias("node")) for level in range(bits // LEVEL_BITS + 1)])
    return leaves.select(F.inline(steps), "rows", "digest").groupBy("level", "node").agg(F.sum("rows").alias("rows"), F.sum("digest").alias("digest"))


def differing(source: DataFrame, target: DataFrame, bits: int = LEAF_BITS) -> list[int]:
    """Leaves of two trees that differ, found from the root down: children are read of nodes that differ only.

    Where trees are stored by level, equal tables cost one node. At most 2 ** bits numbers come to the driver.
    """
    found = [0]
    for level in range(bits // LEVEL_BITS + 1):
        def side(t: DataFrame, sign: int, level: int = level, above: Sequence[int] = tuple(found)) -> DataFrame:
            nodes = t.where(F.col("level") == level)
            if level:
                parents = F.broadcast(t.sparkSession.createDataFrame([(n,) for n in above], "parent int"))
                nodes = nodes.join(parents, F.shiftright("node", LEVEL_BITS) == F.col("parent"), "left_semi")
            return nodes.select("node", (F.col("rows") * sign).alias("rows"), (F.col("digest") * sign).alias("digest"))

        both = side(source, 1).unionByName(side(target, -1)).groupBy("node").agg(F.sum("rows").alias("rows"), F.sum("digest").alias("digest"))
        found = sorted(r["node"] for r in both.where("rows != 0 OR digest != 0").select("node").collect())
        if not found:
            break
    return found


def in_leaves(rows: DataFrame, keys: Sequence[str], leaves: Sequence[int], bits: int = LEAF_BITS) -> DataFrame:
    """The rows of some leaves. The numbers of leaves are broadcast: 2 ** MOST_BITS integers at most, 4 MB."""
    wanted = F.broadcast(rows.sparkSession.createDataFrame([(n,) for n in leaves], "__leaf int"))
    return rows.join(wanted, leaf_of(keys, bits) == F.col("__leaf"), "left_semi")


def reconcile_tree(
    source: DataFrame, target: DataFrame, keys: Sequence[str], cols: Sequence[str], bits: int = LEAF_BITS, source_tree: DataFrame | None = None, target_tree: DataFrame | None = None
) -> DataFrame:
    """What `reconcile_rows` says, a row per key that differs, but only rows in ranges of keys that differ are shuffled.

    Each side is read twice, the second time without a shuffle but for those ranges; a side whose tree is given is read once. With D differing keys about
    D / 2 ** bits of all rows go on, and none if the tables are equal. A null key is a key like any other; repeated rows count each; empty tables are equal.
    """
    trees = [given if given is not None else tree(rows, keys, cols, bits) for given, rows in ((source_tree, source), (target_tree, target))]
    leaves = differing(*[t.persist() for t in trees], bits)
    for t in trees:
        t.unpersist()
    return reconcile_rows(*[in_leaves(rows, keys, leaves, bits) for rows in (source, target)], keys, [*keys, *cols])
