"""A Merkle manifest of a dataset: trees per group, a tree over their roots, inclusion proofs.

Leaves are hashes of whole rows. Within a group they stand in the order of a key; every run
of ``arity`` neighbours becomes one node of the next level, until one node, the subroot, is
left. The subroots, in the order of their groups, make one more tree, whose top is the root.

A level is one self-join: each node meets its siblings by an equijoin on their computed
places (its place with the slot inside the run shifted by 1, 2, ...; with two slots, the
place with its last bit flipped), and the rows in slot zero emit the parents. Proofs go
down again by joins of nodes with their parents. A key of these joins stands for one node,
so that a group holding most rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.session import checkpointed

ARITY = 3
_STEPS = "array<struct<left: binary, right: binary>>"


def field_text(column: Column) -> Column:
    """A value as the manifest hashes it: its UTF-8 bytes' number, a colon, itself; ``-`` for null."""
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_hash(columns: Sequence[Column]) -> Column:
    """The leaf of a row: SHA-256 of its fields, as bytes."""
    return F.unhex(F.sha2(F.concat(*[field_text(c) for c in columns]), 256))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _places(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``at`` (place within ``tree`` in the given order, from 0) and ``count`` (rows of the tree).

    Rows are dealt out by ranges of (tree, order) and numbered inside each range; a range
    adds what the ranges before hold of its tree. Only one row per range and tree meets in
    a window.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    numbered = checkpointed(ranged.withColumn("number", F.monotonically_increasing_id()))
    # the id's upper bits are the range
    numbered = numbered.withColumn("range", F.shiftright("number", 33))
    ranges = numbered.groupBy("tree", "range").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        "tree",
        "range",
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(whole).alias("count"),
    )
    placed = numbered.join(offsets, ["tree", "range"]).withColumn("at", F.col("number") + F.col("shift"))
    return placed.drop("range", "number", "shift")


def _level(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes of trees that are not finished, with the hashes of the siblings to the ``left`` and ``right``."""
    nodes = nodes.where("count > 1").withColumn("slot", F.col("at") % arity)
    joined = nodes
    for shift in range(1, arity):
        place = F.col("at") - F.col("slot") + (F.col("slot") + shift) % arity
        sibling = nodes.select("tree", F.col("at").alias(f"at{shift}"), F.col("hash").alias(f"hash{shift}"))
        joined = joined.withColumn(f"at{shift}", place).join(sibling, ["tree", f"at{shift}"], "left")
    others = F.array(*[f"hash{shift}" for shift in range(1, arity)])
    empty = F.lit(b"")

    def at_slot(slot: int) -> Column:
        """The sibling in a slot, empty where the run has none."""
        return F.coalesce(F.get(others, ((F.lit(slot) - F.col("slot") + arity) % arity - 1).cast("int")), empty)

    left = F.concat(*[F.when(F.col("slot") > s, at_slot(s)).otherwise(empty) for s in range(arity - 1)])
    right = F.concat(*[F.when(F.col("slot") < s, at_slot(s)).otherwise(empty) for s in range(1, arity)])
    return joined.select("tree", "at", "count", "hash", "slot", left.alias("left"), right.alias("right"))


def _parents(level: DataFrame, arity: int) -> DataFrame:
    digest = F.unhex(F.sha2(hex_text(F.concat("hash", "right")), 256))
    return level.where("slot = 0").select(
        "tree",
        F.expr(f"at div {arity}").alias("at"),
        F.expr(f"(count + {arity - 1}) div {arity}").alias("count"),
        digest.alias("hash"),
    )


def grow(nodes: DataFrame, arity: int = ARITY) -> tuple[DataFrame, DataFrame]:
    """From leaves ``tree, at, count, hash`` to tops ``tree, top`` and proofs ``tree, at, steps``.

    ``steps`` are the leaf's ways up, each with the siblings' digests on the left and on the
    right; a tree of one leaf has none. Every level is written once.
    """
    widest = nodes.agg(F.max("count")).first()[0] or 0
    tops, levels = [nodes.where("count = 1")], []
    while widest > 1:
        levels.append(checkpointed(_level(nodes, arity)))
        nodes = _parents(levels[-1], arity)
        tops.append(nodes.where("count = 1"))
        widest = -(-widest // arity)
    top = reduce(DataFrame.unionByName, [t.select("tree", F.col("hash").alias("top")) for t in tops])
    none = F.array().cast(_STEPS)
    proofs = tops[0].select("tree", "at", none.alias("steps"))
    above = None
    for level in reversed(levels):
        step = F.array(F.struct("left", "right")).cast(_STEPS)
        if above is None:
            above = level.select("tree", "at", step.alias("steps"))
            continue
        higher = above.select("tree", F.col("at").alias("run"), F.col("steps").alias("higher"))
        mine = level.withColumn("run", F.expr(f"at div {arity}"))
        steps = F.concat(step, F.coalesce("higher", none))
        above = mine.join(higher, ["tree", "run"], "left").select("tree", "at", steps.alias("steps"))
    return top, proofs if above is None else above.unionByName(proofs)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its proof give, as lower-case hex."""
    return F.aggregate(
        steps,
        hex_text(leaf),
        lambda below, step: F.sha2(F.concat(hex_text(step["left"]), below, hex_text(step["right"])), 256),
    )


def proof_text(steps: Column) -> Column:
    """The siblings of a proof from the leaf's level to the root, left to right, as hex text."""
    return F.array_join(F.transform(steps, lambda step: hex_text(F.concat(step["left"], step["right"]))), "")


def merkle_manifest(
    rows: DataFrame,
    fields: Sequence[str | Column],
    key: str,
    group: str,
    arity: int = ARITY,
    altered: Sequence[str | Column] | None = None,
) -> DataFrame:
    """One row per input row: ``key``, ``leaf``, its group's ``subroot``, the ``root`` and its proof.

    ``fields`` are hashed in order into the leaf. Leaves of a group ascend by ``key``, null
    first, rows with one key by their hash; groups ascend, null first, by their bytes.
    ``steps`` is the proof, which ``fold`` and ``proof_text`` read. With ``altered``, other
    values of the fields, ``altered_leaf`` is the hash of those, to be checked against the
    proof.

    Nulls and empty texts hash differently; a text of any length is hashed whole inside its
    row. Rows that repeat are leaves of their own (equal ones share all but the place).
    An empty table gives an empty manifest. Columns not named as fields are ignored.
    """
    def column(c: str | Column) -> Column:
        return F.col(f"`{c}`") if isinstance(c, str) else c

    name = F.col(f"`{group}`").cast("string")
    leaves = rows.select(
        # null is before every group, the empty one too
        F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), name)).alias("tree"),
        F.col(f"`{key}`").alias("key"),
        row_hash([column(c) for c in fields]).alias("hash"),
        *([row_hash([column(c) for c in altered]).alias("altered")] if altered else []),
    )
    leaves = checkpointed(_places(leaves, ["key", "hash"]))
    subroots, proofs = grow(leaves.select("tree", "at", "count", "hash"), arity)
    groups = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("its"), F.col("top").alias("hash"))
    groups = checkpointed(_places(groups, ["its"]))
    root, above = grow(groups.select("tree", "at", "count", "hash"), arity)
    groups = groups.join(above, ["tree", "at"]).join(root, "tree").select(
        F.col("its").alias("tree"), F.col("hash").alias("subroot"), F.col("top").alias("root"), F.col("steps").alias("above")
    )
    found = leaves.join(proofs, ["tree", "at"]).join(checkpointed(groups), "tree")
    return found.select(
        F.col("key").alias(key),
        hex_text(F.col("hash")).alias("leaf"),
        hex_text(F.col("subroot")).alias("subroot"),
        hex_text(F.col("root")).alias("root"),
        F.concat("steps", "above").alias("steps"),
        *([F.col("altered").alias("altered_leaf")] if altered else []),
    )
