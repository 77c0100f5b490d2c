"""Merkle manifest of a table by sibling-shift self-joins, with a proof for every row.

A row's leaf is a hash of its columns. The leaves of a group (a source) ascend by the order column and
form a tree of ``slots`` children a node; the groups' roots, in order of the groups, form the top tree.
At every level nodes are (tree, idx). The node of slot zero of each run computes the indices of its
siblings (its own plus each slot offset; with two slots that is the index XOR 1) and an equijoin of the
level with itself finds them; slot-zero rows then emit the parents. A row finds the run that holds its
siblings by the computed index of its own slot zero, and what lies above it by that of its parent.

Places in a group come from one range partitioning over (group, order) with sizes added up for each
partition, so a group of any size is numbered by many tasks; no group is ever one task or one window.
Partition sizes are broadcast (a row for each partition); all other joins are left to Spark, which
broadcasts a side only by its measured size and splits hot groups.

Defined results: null groups are one group, before all others; null order values come first; rows of
equal group and order are placed in the order of their leaves, so that rows which repeat in every
hashed column have interchangeable places. An empty table has no root and gives no rows. A kept column
that bears the name of an added column gets ``_`` appended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, col, cut

DIGEST = 64  # characters of a digest in hex
PATH = "array<struct<slot:int,run:string>>"
TOP = -1  # the tree of the groups' roots
_ADDED = ("leaf", "subroot", "root", "path")


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_of(values: list[Column]) -> Column:
    """The leaf of a row: for each value ``-`` if it is null, else its UTF-8 byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to: at each level the digest of the run with the own slot replaced."""
    return F.aggregate(path, leaf, lambda own, level: F.sha2(F.overlay(level["run"], own, level["slot"] * DIGEST + 1, F.lit(DIGEST)), 256))


def siblings(path: Column) -> Column:
    """Digests of all siblings from the leaf's level up to the root, left to right, joined."""
    return F.array_join(F.transform(path, lambda level: F.overlay(level["run"], F.lit(""), level["slot"] * DIGEST + 1, F.lit(DIGEST))), "")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with its dense 0-based place in ``order`` (bigint ``name``); equal rows in any order.

    Rows are ranged over partitions (also equal ones, by their row numbers) and stored; a row's place is
    its place in the partition plus the sizes of the earlier ones.
    """
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    placed = cut(ranged.withColumn("__pid", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    sizes = placed.groupBy("__pid").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"))
    before = sizes.select(F.col("__pid").alias("p"), "first", (F.sum("n").over(Window.orderBy("__pid")) - F.col("n")).alias("before"))  # a row for each partition
    moved = placed.join(F.broadcast(before), F.col("__pid") == F.col("p"))
    return moved.select(*[col(c) for c in df.columns], (F.col("before") + F.col("__at") - F.col("first")).alias(name))


def _climb(nodes: DataFrame, largest: int, slots: int) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level and the roots of all trees.

    ``nodes`` are (tree, idx, n, hash) with n the nodes of the tree at this level, ``largest`` the
    largest n. A run is (tree, up, n, run): the index of its parent and its digests, joined. Roots are
    (tree, level, hash).
    """
    runs: list[DataFrame] = []
    roots = nodes.where("n = 1").select("tree", F.lit(0).alias("level"), "hash")
    while largest > 1:
        level = nodes.where("n > 1")
        offsets = F.sequence(F.lit(0).cast("long"), F.least(F.lit(slots - 1).cast("long"), F.col("n") - 1 - F.col("idx")))
        asked = level.where(F.col("idx") % slots == 0).select("tree", "idx", "n", F.explode(offsets).alias("slot"))
        there = level.select(F.col("tree").alias("t"), F.col("idx").alias("sibling"), "hash")
        found = asked.join(there, (F.col("tree") == F.col("t")) & (F.col("idx") + F.col("slot") == F.col("sibling")))
        held = F.array_sort(F.collect_list(F.struct("slot", "hash")))  # as many as slots at most
        run = found.groupBy("tree", "idx").agg(F.max("n").alias("n"), F.array_join(F.transform(held, lambda s: s["hash"]), "").alias("run"))
        runs.append(cut(run.select("tree", F.expr(f"idx div {slots}").alias("up"), "n", "run")))
        nodes = runs[-1].select("tree", F.col("up").alias("idx"), F.ceil(F.col("n") / slots).alias("n"), F.sha2("run", 256).alias("hash"))
        largest = -(-largest // slots)
        roots = roots.unionByName(nodes.where("n = 1").select("tree", F.lit(len(runs)).alias("level"), "hash"))
    return runs, roots


def _step(slot: Column, run: Column, above: Column) -> Column:
    """The path that begins with this slot of this run."""
    return F.concat(F.array(F.struct(slot.cast("int").alias("slot"), run.alias("run"))).cast(PATH), above)


def _above(runs: list[DataFrame], roots: DataFrame, slots: int) -> DataFrame:
    """What lies above the leaves of all trees: (tree, up, run, path, subroot).

    ``roots`` are (tree, level, path, subroot). A row stands for the run of leaves whose parent is
    ``up``; a tree that is a leaf has a row without a run.
    """
    ended = lambda level: roots.where(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("idx"), "path", "subroot")
    nodes = ended(len(runs))
    for level in reversed(range(len(runs))):
        parents = nodes.select(F.col("tree").alias("t"), "idx", "path", "subroot")
        found = runs[level].join(parents, (F.col("tree") == F.col("t")) & (F.col("up") == F.col("idx"))).select("tree", "up", "run", "path", "subroot")
        if not level:
            return found.unionByName(ended(0).select("tree", F.col("idx").alias("up"), F.lit(None).cast("string").alias("run"), "path", "subroot"))
        each = found.withColumn("slot", F.explode(F.sequence(F.lit(0), (F.length("run") / DIGEST).cast("int") - 1)))
        nodes = each.select("tree", (F.col("up") * slots + F.col("slot")).alias("idx"), _step(F.col("slot"), F.col("run"), F.col("path")).alias("path"), "subroot")
        nodes = nodes.unionByName(ended(level))
    return nodes.select("tree", F.col("idx").alias("up"), F.lit(None).cast("string").alias("run"), "path", "subroot")


@dataclass
class Manifest:
    """A built manifest: leaves (tree, idx, n, leaf and kept columns), runs and roots of both kinds of trees."""

    leaves: DataFrame
    runs: list[DataFrame]
    subroots: DataFrame  # tree, level, subroot, rank in the top tree
    top_runs: list[DataFrame]
    root: str | None
    slots: int
    keep: list[str]

    def proofs(self) -> DataFrame:
        """For every row its kept columns, ``leaf``, ``subroot``, ``root`` and ``path`` (slot and run of each level, the leaf's first)."""
        top = self.subroots.sparkSession.createDataFrame([(TOP, len(self.top_runs), [], self.root)], f"tree long, level int, path {PATH}, subroot string")
        over = _above(self.top_runs, top, self.slots)
        rank = self.subroots.withColumn("parent", F.expr(f"rank div {self.slots}"))
        placed = rank.join(over.select("up", "run", "path"), F.col("parent") == F.col("up"))
        path = F.when(F.col("run").isNull(), F.col("path")).otherwise(_step(F.col("rank") % self.slots, F.col("run"), F.col("path")))
        roots = cut(placed.select("tree", "level", path.alias("path"), "subroot"))
        above = _above(self.runs, roots, self.slots).select(F.col("tree").alias("t"), "up", "run", "path", "subroot")
        rows = self.leaves.withColumn("parent", F.expr(f"idx div {self.slots}"))
        joined = rows.join(above, (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("up")))
        path = F.when(F.col("run").isNull(), F.col("path")).otherwise(_step(F.col("idx") % self.slots, F.col("run"), F.col("path")))
        names = apart(self.keep, _ADDED)
        kept = [F.col(f"kept.c{k}").alias(n) for k, n in enumerate(names)]
        return joined.select(*kept, "leaf", "subroot", F.lit(self.root).alias("root"), path.alias("path"))

    def nodes(self) -> DataFrame:
        """All inner nodes as a table to be stored: ``tree`` (-1: of the groups' roots), ``level`` from 1, ``idx``, ``hash``."""
        runs = [(level + 1, run) for some in (self.runs, self.top_runs) for level, run in enumerate(some)]
        out = self.leaves.sparkSession.createDataFrame([], "tree long, level int, idx long, hash string")
        for level, run in runs:
            out = out.unionByName(run.select("tree", F.lit(level).alias("level"), F.col("up").alias("idx"), F.sha2("run", 256).alias("hash")))
        return out


def build(df: DataFrame, columns: list[str], group: str, order: str, keep: list[str] | None = None, slots: int = 16) -> Manifest:
    """The manifest of ``df`` over the hashed ``columns``; ``keep`` names columns that proofs return (default: ``order``)."""
    keep = [order] if keep is None else keep
    kept = F.struct(F.lit(0).alias("none"), *[col(c).alias(f"c{k}") for k, c in enumerate(keep)])
    name = F.coalesce(F.concat(F.lit("="), col(group).cast("string")), F.lit(""))  # null before all others
    hashed = cut(df.select(name.alias("group"), col(order).alias("order"), leaf_of([col(c) for c in columns]).alias("leaf"), kept.alias("kept")))
    rows = numbered(hashed, ["group", "order", "leaf"], "place")
    # a tree bears the number of its first leaf
    trees = cut(rows.groupBy("group").agg(F.min("place").alias("tree"), F.count(F.lit(1)).alias("n")))
    joined = rows.join(trees.withColumnRenamed("group", "g"), F.col("group") == F.col("g"))
    leaves = cut(joined.select("tree", (F.col("place") - F.col("tree")).alias("idx"), "n", "leaf", "kept"))
    size = trees.agg(F.count(F.lit(1)).alias("trees"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()  # one row
    runs, roots = _climb(leaves.select("tree", "idx", "n", F.col("leaf").alias("hash")), size.most, slots)
    subroots = cut(numbered(roots, ["tree"], "rank").withColumnRenamed("hash", "subroot"))
    top = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("rank").alias("idx"), F.lit(size.trees).cast("long").alias("n"), F.col("subroot").alias("hash"))
    top_runs, ends = _climb(top, size.trees, slots)
    root = ends.first()  # one row
    return Manifest(leaves, runs, subroots, top_runs, root.hash if root else None, slots, keep)
