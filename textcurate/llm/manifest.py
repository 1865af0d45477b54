"""Merkle manifest of a dataset: one tree of digests per group of rows, a tree over their roots, and proofs for every row.

Every node is labelled with the interval of leaf ranks that it covers, and labels are all that relates nodes. Rows meet
their ancestors level by level in joins on containment, within buckets as wide as a parent; a node's siblings are the
children of its parent whose intervals lie outside its own. Ranks come from one range exchange of digests; texts are read
once and never moved. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textcurate.plans.scratch import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Leaves a range partition sorts; a leaf is about 200 bytes.
PARTITION_LEAVES = 4_000_000
_STEP = "struct<left:string,right:string>"


def record_digest(values: list[Column]) -> Column:
    """SHA-256, in lowercase hex, of all values, each ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda c: c["digest"]), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and the siblings on its path make."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def siblings_digest(path: Column) -> Column:
    """One digest of all siblings on a path, level by level up to the root, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _ranked(leaves: DataFrame) -> DataFrame:
    """Add ``lo`` (the rank within the tree, from 0), ``hi`` and ``n`` (the tree's leaves) to ``(tree, key, digest, ...)``.

    Rows that are equal in all three are told apart by a stored number, so that a range never has to hold all of them. A
    tree of any size is cut over as many ranges as it fills.
    """
    spark = leaves.sparkSession
    stored = materialize(leaves.withColumn("row", F.monotonically_increasing_id()), "manifest-leaves")
    rows = stored.count()
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 1000), rows // PARTITION_LEAVES)
    order = ["tree", "key", "digest", "row"]
    sorted_ = stored.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = sorted_.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    placed = materialize(placed.drop("row"), "manifest-order")
    # One row per tree and range that holds some of it.
    runs = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
    shifts = runs.select("tree", "part", start.alias("shift"), F.sum("n").over(whole).alias("n"))
    out = placed.join(shifts, ["tree", "part"]).withColumn("lo", F.col("at") + F.col("shift"))
    return out.withColumn("hi", F.col("lo") + 1).drop("part", "at", "shift")


def _parents(nodes: DataFrame, level: int, fanout: int) -> DataFrame:
    """The nodes of a level, from those of the level below in trees that still have several."""
    width = fanout**level
    several = nodes.filter(F.col("n") > width // fanout)
    # At most ``fanout`` children each.
    children = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children")
    grouped = several.groupBy("tree", "n", F.floor(F.col("lo") / width).alias("bucket")).agg(children)
    return grouped.select(
        "tree",
        "n",
        F.col("children")[0]["lo"].alias("lo"),
        F.element_at("children", -1)["hi"].alias("hi"),
        F.sha2(_joined(F.col("children")), 256).alias("digest"),
        "children",
    )


@dataclass(frozen=True)
class Trees:
    """Ranked leaves, and the written nodes of each level above them."""

    leaves: DataFrame
    levels: list[DataFrame]
    fanout: int

    @classmethod
    def build(cls, leaves: DataFrame, fanout: int) -> Trees:
        leaves = materialize(_ranked(leaves), "manifest-ranked")
        largest = leaves.agg(F.max("n")).first()[0] or 0
        levels = []
        while fanout ** len(levels) < largest:
            below = levels[-1] if levels else leaves
            levels.append(materialize(_parents(below, len(levels) + 1, fanout), "manifest-level"))
        return cls(leaves, levels, fanout)

    def nodes(self) -> DataFrame:
        """``(tree, level, lo, hi, digest)``: every node and the leaf ranks it covers, ``hi`` exclusive."""
        out = None
        for level, table in enumerate([self.leaves, *self.levels]):
            here = table.select("tree", F.lit(level).alias("level"), "lo", "hi", "digest")
            out = here if out is None else out.unionByName(here)
        return out

    def roots(self) -> DataFrame:
        """``(tree, digest)``: the node that is left of each tree."""
        out = None
        for level, table in enumerate([self.leaves, *self.levels]):
            here = table.filter(F.col("n") <= self.fanout**level).select("tree", "digest")
            out = here if out is None else out.unionByName(here)
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """The leaves with ``path``, their siblings from the lowest level up, continued by what ``above`` holds.

        ``above`` has one row ``(tree, path, ...)`` per tree; its other columns come along.
        """
        carried = [c for c in above.columns if c != "tree"]
        found = None
        for level in range(len(self.levels), -1, -1):
            nodes = self.levels[level - 1] if level else self.leaves
            width = self.fanout ** (level + 1)
            top = nodes.filter(F.col("n") <= self.fanout**level).join(above, "tree")
            if found is not None:
                top = top.unionByName(self._attach(nodes.filter(F.col("n") > self.fanout**level), found, width, carried))
            found = top
        return found

    @staticmethod
    def _attach(nodes: DataFrame, parents: DataFrame, width: int, carried: list[str]) -> DataFrame:
        outer = parents.select(
            F.col("tree").alias("outer_tree"),
            F.floor(F.col("lo") / width).alias("outer_bucket"),
            F.col("lo").alias("outer_lo"),
            F.col("hi").alias("outer_hi"),
            F.col("children").alias("outer_children"),
            *carried,
        )
        inside = (
            (F.col("tree") == F.col("outer_tree"))
            & (F.floor(F.col("lo") / width) == F.col("outer_bucket"))
            & (F.col("lo") >= F.col("outer_lo"))
            & (F.col("hi") <= F.col("outer_hi"))
        )
        joined = nodes.join(outer, inside)
        left = F.filter("outer_children", lambda c: c["hi"] <= F.col("lo"))
        right = F.filter("outer_children", lambda c: c["lo"] >= F.col("hi"))
        step = F.struct(_joined(left).alias("left"), _joined(right).alias("right"))
        joined = joined.withColumn("path", F.concat(F.array(step), "path"))
        return joined.select(*nodes.columns, *carried)


@dataclass(frozen=True)
class Manifest:
    """``root`` is None for an empty table."""

    trees: Trees
    top: Trees
    root: str | None

    def nodes(self) -> DataFrame:
        """``(tree, level, lo, hi, digest)`` of the trees of all groups; ``tree`` is ``=`` and the group, or empty for null."""
        return self.trees.nodes()

    def proofs(self) -> DataFrame:
        """Per row ``id``, ``extra``, ``leaf``, ``subroot``, ``root`` and ``path`` (its siblings, from the lowest level up)."""
        nothing = F.array().cast(f"array<{_STEP}>")
        trees = self.top.leaves.select(F.col("tree").alias("all")).distinct()
        above = self.top.paths(trees.select(F.col("all").alias("tree"), nothing.alias("path")))
        above = above.select(F.col("key").alias("tree"), F.col("digest").alias("subroot"), "path")
        return self.trees.paths(above).select(
            F.col("key").alias("id"), "extra", F.col("digest").alias("leaf"), "subroot", F.lit(self.root).alias("root"), "path"
        )


def build(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    id_column: str = "doc_id",
    group_column: str = "lang",
    extra: Column | None = None,
    fanout: int = 8,
) -> Manifest:
    """The manifest of all rows: a leaf is the digest of the row's ``fields``.

    In each group of ``group_column`` leaves ascend by ``id_column`` (null first), then by digest; runs of ``fanout``
    nodes become their digest until one is left, and the roots of the groups, in order (null first, then by UTF-8
    bytes), likewise give the root. ``extra`` is a value worked out with each leaf and kept beside it. Nulls in any
    field are part of the digest; repeated rows are leaves of their own with equal digests; a group of one row has that
    leaf as its root; an empty table has no root. Other columns are not read. Long texts cost one copy while they
    are hashed. All exchanges are of digests: paths are put together from the top down, so that the level below the
    last carries one path for ``fanout`` leaves.
    """
    group = F.col(group_column).cast("string")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("tree"),
        F.col(id_column).alias("key"),
        record_digest([F.col(f) for f in fields]).alias("digest"),
        (F.lit(None).cast("string") if extra is None else extra).alias("extra"),
    )
    trees = Trees.build(leaves, fanout)
    subroots = trees.roots().select(F.lit("all").alias("tree"), F.col("tree").alias("key"), "digest")
    top = Trees.build(subroots, fanout)
    root = top.roots().select("digest").first()  # one row
    return Manifest(trees, top, root[0] if root else None)


def verify(proofs: DataFrame, leaf: Column) -> DataFrame:
    """``(id, leaf, subroot, root, proof_sha256, folded_root, verified)``: does ``leaf`` still lead to the root?"""
    folded = proofs.withColumn("folded_root", fold(leaf, F.col("path")))
    return folded.select(
        "id",
        "leaf",
        "subroot",
        "root",
        siblings_digest(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
