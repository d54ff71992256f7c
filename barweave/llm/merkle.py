"""Merkle manifest of a dataset: one digest for all rows, and a proof for each.

Rows are leaves of one tree per source, in which every `ARITY` consecutive nodes have their digest as parent; the sources'
roots are the leaves of a last tree. Leaves are ranked within their tree by a range-partitioned sort and counts per
partition, so a source of any size is spread over all tasks. `ARITY ** HEIGHT` consecutive leaves are a superblock:

1. A superblock is reduced to its top node; the top nodes are the leaves of a tree that is smaller by that factor, until
   one node a tree is left.
2. On the way back each superblock gets the nodes outside it that its proofs need, a few per level, in one row. Leaves and
   these rows are cogrouped by superblock, and `applyInPandas` finishes the reduction inside, joins the proofs and folds.

A row is proved by folding its leaf with its siblings; a tampered row folds to another root.

Defined cases: a null field is written as ``-``, so it differs from an empty one. Leaves ascend by doc_id, null first,
and rows with the same doc_id by leaf; equal rows are leaves of their own. Texts of any length are hashed whole where they
are read and are not shuffled. A null doc_id counts as not tampered. An empty table has no rows and no root. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barweave.llm.common import stored, table

ARITY = 3
HEIGHT = 7  # levels of a superblock
PATH = "array<struct<before: string, after: string>>"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def parents(nodes: list[str], arity: int) -> list[str]:
    return [digest("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]


def levels(nodes: list[str], height: int | None, arity: int) -> list[list[str]]:
    """The nodes and the levels above them: `height` of them, or up to a single node."""
    out = [nodes]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        out.append(parents(out[-1], arity))
    return out


def siblings(above: list[list[str]], leaf: int, arity: int) -> list[tuple[str, str]]:
    """What stands before and after the leaf's ancestor in its run, level by level."""
    path = []
    for nodes in above[:-1]:
        first = leaf - leaf % arity
        path.append(("".join(nodes[first:leaf]), "".join(nodes[leaf + 1 : first + arity])))
        leaf //= arity
    return path


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        leaf = digest(before + leaf + after)
    return leaf


def field_text(column: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    value = column.cast("string")
    return F.when(column.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(text: Column) -> Column:
    fields = [field_text(text if name == "text" else F.col(name)) for name in FIELDS]
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def ranked(rows: DataFrame, tree: str, order: list[str | Column]) -> DataFrame:
    """Adds `spot`, the place within its tree in the given order, and `size`, the rows of the tree.

    The order has to tell all rows of a tree apart. Only counts per tree and partition are gathered.
    """
    sorted_rows = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    marked = stored(sorted_rows.withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33).alias("part")
    counts = marked.groupBy(F.col(tree).alias("of"), part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("of")
    offset = F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")
    counts = counts.select("of", "part", offset.alias("offset"), F.sum("n").over(whole).alias("size"))
    placed = marked.withColumn("part", part).join(counts, F.col(tree).eqNullSafe(F.col("of")) & (part == counts["part"]))
    return placed.withColumn("spot", F.col("at") + F.col("offset")).drop("at", "offset", "of", "part")


def _units(leaves: DataFrame, block: int, groups: int) -> DataFrame:
    """Adds the superblock of each leaf and the group that it is worked in; trees smaller than a superblock share groups."""
    return _teams(leaves.withColumn("unit", F.expr(f"spot div {block}")), groups)


def _teams(rows: DataFrame, groups: int) -> DataFrame:
    return rows.withColumn("team", F.pmod(F.xxhash64("tree", "unit"), F.lit(groups)))


def _split(team: pd.DataFrame) -> Iterator[tuple[int, int, pd.DataFrame]]:
    """tree, unit and leaves in order of each superblock of a group."""
    for (tree, unit), leaves in team.groupby(["tree", "unit"], sort=False):
        yield tree, unit, leaves.sort_values("spot")


def _height(size: int, block: int, height: int) -> int | None:
    """Levels that a superblock of a tree of `size` leaves is reduced by; None: to its only node."""
    return height if size > block else None


def tops(units: DataFrame, height: int, arity: int) -> DataFrame:
    """tree, spot, size and digest of the top node of every superblock."""
    block = arity**height

    def reduce(team: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for tree, unit, leaves in _split(team):
            size = int(leaves["size"].iloc[0])
            top = levels(leaves["digest"].tolist(), _height(size, block, height), arity)[-1][0]
            rows.append((tree, unit, -(-size // block), top))
        return pd.DataFrame(rows, columns=["tree", "spot", "size", "digest"])

    few = units.select("team", "tree", "unit", "spot", "size", "digest")
    return few.groupBy("team").applyInPandas(reduce, "tree long, spot long, size long, digest string")


def proved(leaves: DataFrame, height: int = HEIGHT, arity: int = ARITY) -> DataFrame:
    """tree, spot, path and root of every leaf (tree, spot, size, digest) of a forest; written tables between the rounds."""
    block = arity**height
    largest, n = leaves.agg(F.max("size"), F.count(F.lit(1))).first()
    groups = max(1, -(-n // block))
    units = _units(leaves, block, groups)
    above = stored(tops(units, height, arity), "tops")
    if (largest or 0) > block:
        outer = proved(above, height, arity)
    else:
        outer = above.select("tree", "spot", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    outer = outer.select("tree", F.col("spot").alias("unit"), "path", F.struct("root").alias("outside"))
    return finished(units, _teams(outer, groups), height, arity).select("tree", "spot", "path", "outside.root")


def finished(units: DataFrame, outer: DataFrame, height: int, arity: int, folded: bool = False) -> DataFrame:
    """Leaves cogrouped with one row (tree, unit, team, path, outside) per superblock.

    The result has tree, spot, outside, and the path of each leaf; if `folded`, instead the digest of its path and what
    `altered`, a digest that may stand in for the leaf's own, folds to.
    """
    block = arity**height
    outside = outer.schema["outside"].dataType.simpleString()
    schema = f"tree long, spot long, outside {outside}, " + ("proof_sha256 string, folded_root string" if folded else f"path {PATH}")

    def join(team: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        given = {(r.tree, r.unit): r for r in nodes.itertuples(index=False)}
        rows = []
        for tree, unit, leaves in _split(team):
            size, node = int(leaves["size"].iloc[0]), given[tree, unit]
            above = levels(leaves["digest"].tolist(), _height(size, block, height), arity)
            beyond = [(s["before"], s["after"]) for s in node.path]
            altered = leaves["altered"] if folded else leaves["digest"]
            for i, (spot, leaf) in enumerate(zip(leaves["spot"].tolist(), altered.tolist(), strict=True)):
                path = siblings(above, i, arity) + beyond
                if folded:
                    rows.append((tree, spot, node.outside, digest("".join(b + a for b, a in path)), fold(leaf, path)))
                else:
                    rows.append((tree, spot, node.outside, [{"before": b, "after": a} for b, a in path]))
        return pd.DataFrame(rows, columns=["tree", "spot", "outside", *(["proof_sha256", "folded_root"] if folded else ["path"])])

    columns = ["team", "tree", "unit", "spot", "size", "digest", *(["altered"] if folded else [])]
    left = units.select(*columns).groupBy("team")
    return left.cogroup(outer.groupBy("team")).applyInPandas(join, schema)


def manifest(docs: DataFrame, altered_text: Column, height: int = HEIGHT, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row, each folded from `altered_text`.

    `altered_text` is the text, by columns of the table, that the proof of a row is tried on.
    """
    docs = docs.select(*FIELDS)
    leaves = docs.select("source", "doc_id", leaf_digest(F.col("text")).alias("digest"), leaf_digest(altered_text).alias("altered"))
    leaves = stored(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")

    # trees are numbered in the order of their sources, null first
    sources = leaves.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0))
    sources = ranked(sources, "all", [F.col("name").asc_nulls_first()]).select("name", F.col("spot").alias("tree"))
    sources = stored(sources, "sources")
    spots = ranked(leaves, "source", [F.col("doc_id").asc_nulls_first(), "digest", "row"])
    spots = spots.join(sources, F.col("source").eqNullSafe(F.col("name")))
    spots = stored(spots.select("tree", "spot", "size", "digest", "altered", "doc_id"), "spots")

    block = arity**height
    groups = max(1, -(-spots.count() // block))
    units = _units(spots, block, groups)
    above = stored(tops(units, height, arity), "tops")
    inner = stored(proved(above, height, arity), "paths")  # from the superblocks to the sources' roots
    roots = inner.select("tree", F.col("root").alias("digest")).distinct()
    n_sources = roots.count()
    last = roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("spot"), F.lit(n_sources).cast("long").alias("size"), "digest")
    last = proved(last, height, arity).select(F.col("spot").alias("tree"), F.col("path").alias("rest"), F.col("root").alias("whole"))
    outer = inner.join(last, "tree").select(
        "tree", F.col("spot").alias("unit"), F.concat("path", "rest").alias("path"),
        F.struct(F.col("root").alias("subroot"), F.col("whole").alias("root")).alias("outside"),
    )
    folded = finished(units, _teams(outer, groups), height, arity, folded=True).select("tree", "spot", "outside.*", "proof_sha256", "folded_root")
    return spots.select("tree", "spot", "doc_id", F.col("digest").alias("leaf")).join(folded, ["tree", "spot"]).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(table(spark, sf_dir, "documents"), F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text")))
