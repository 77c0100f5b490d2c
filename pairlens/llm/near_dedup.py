"""Near-duplicate documents by chosen-path set similarity join.

A document's set is its distinct word shingles. Documents of equal sets are one class, of which only
a text of the smallest id goes on, under a number of its own: rows of one id with different texts are
compared each by its own text, and become one vertex only when components are named. Each of
``trees`` independent trees branches the classes by selected minwise tokens: at a node, a hash of the node chooses which minwise token leads on. The first ``depth`` levels
are taken at once; classes that meet in no node are done. Then candidates are confirmed on the full
sets and merged into components, in rounds, so that pairs which are connected already are not
compared again:

1. each class with the smallest members of its nodes;
2. in nodes that still hold several components: nodes of at most ``small`` members are compared
   exhaustively by signatures; larger ones branch on by two further tokens each, and after
   ``more_levels`` levels are compared in blocks of members, which together hold every pair. A pair
   is passed on only in the first tree that compares it for certain; branching may part it, so a
   pair of a node that branched is tried again in every later tree.

A pair with Jaccard similarity s meets in a tree with probability s ** depth or more; at s = 0.85,
16 trees of depth 3 miss it less than once in 10 ** 6, at s = 0.8 once in 10 ** 5 (if all its nodes
branch, three times in 10 ** 5). Signatures of
``SIGNATURE`` bytes are made for classes that meet another one; the filter on them keeps pairs down
to ``deviations`` standard deviations below the threshold: with six, a pair at the threshold is lost
once in 10 ** 9. With ``deviations=None`` no pair that meets is filtered: all are tested on full sets.

Defined results: texts without words have the empty set and are linked with nothing; fewer words than
a shingle make one shingle. Null ids count as smaller than all others; rows of one id are one vertex.
Texts of any length are used whole. ``near_duplicates`` returns its four columns only,
``without_near_duplicates`` the rows of its input as they are, whatever their columns are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WHITE, col, cut, gathered, lean, mix, sequence_name, sliced, text_buffers, window_names, word_names, word_spans
from .components import components

_U = np.uint64
TOKENS = 96  # minwise tokens that trees choose from
SIGNATURE = 512
LEAST = -(2**63)  # stands for a null id
_RNG = np.random.default_rng(41)
_MUL = _RNG.integers(0, 2**32, SIGNATURE, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 2**32, SIGNATURE, dtype=np.uint32)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle names of each text."""
    data, at = text_buffers(column)
    data = LOWER[data]
    starts, ends, doc_at = word_spans(data, at, WHITE)
    names = word_names(data, starts, ends)
    windows = window_names(names, width)
    out = []
    for a, b in zip(doc_at[:-1].tolist(), doc_at[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(windows[a : b - width + 1]))
        else:
            out.append(sequence_name(names[a:b]) if b > a else np.zeros(0, np.uint64))
    return out


def minwise(sets: list[np.ndarray], count: int) -> np.ndarray:
    """Minwise values (n x count uint32); empty sets give zeros."""
    out = np.zeros((len(sets), count), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    x = (np.concatenate([sets[i] for i in full]) >> _U(32)).astype(np.uint32)
    at = np.cumsum([0, *(len(sets[i]) for i in full)])[:-1]
    for k in range(count):
        y = (x ^ _ADD[k]) * _MUL[k]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out[full, k] = np.minimum.reduceat(y, at)
    return out


def _choice(node: np.ndarray, branch: int, count: int) -> np.ndarray:
    return (mix(node + _U(2 * branch + 1)) % _U(count)).astype(np.int64)


def paths(tokens: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Node of each row in each tree after ``depth`` levels (n x trees)."""
    rows = np.arange(len(tokens))
    out = np.empty((len(tokens), trees), np.uint64)
    for tree in range(trees):
        node = np.full(len(tokens), mix(np.array([tree + 1], np.uint64))[0])
        for _ in range(depth):
            node = mix(node * _U(0xC2B2AE3D27D4EB4F) + tokens[rows, _choice(node, 0, TOKENS)].astype(np.uint64))
        out[:, tree] = node
    return out


def _describe(width: int, trees: int, depth: int):
    names = ["id", "tag", "n", "d1", "d2", "nodes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                sets = shingle_sets(part.column(2), width)
                nodes = paths(minwise(sets, TOKENS), trees, depth)
                digest = np.array([[np.sum(mix(s + _U(k)), dtype=np.uint64) for k in (1, 2)] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digest[:, 0]),
                        pa.array(digest[:, 1]),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * trees, pa.int32()), pa.array(nodes.view(np.int64).ravel())),
                    ],
                    names=names,
                )

    return run


def _sign(width: int):
    """Signatures: the lowest byte of each minwise value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text", 1 << 20):
                low = (minwise(shingle_sets(part.column(2), width), SIGNATURE) & np.uint32(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in low], pa.binary())], names=["id", "nodes", "sig"])

    return run


def _matrix(column) -> np.ndarray:
    """Signature rows as a matrix."""
    data, _ = text_buffers(column)
    return data.reshape(-1, SIGNATURE)


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(axis=1, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same)], names=["a", "b", "same"])


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None  # rows of one ``a`` come together
        for batch in batches:
            for part in sliced(batch, "tb"):
                ids = part.column(0).to_pylist()
                others = shingle_sets(part.column(3), width)
                linked = []
                for i, (a, other) in enumerate(zip(ids, others)):
                    if a != last:
                        last, own = a, shingle_sets(part.column(2).slice(i, 1), width)[0]
                    both = np.concatenate([own, other])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    linked.append(100 * shared >= percent * (len(own) + len(other) - shared))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(linked)], names=["a", "b", "linked"])

    return run


def _compare(members: np.ndarray, labels: np.ndarray, sig: np.ndarray, earlier: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different labels whose signatures agree in ``least`` places or more; smaller id first.

    ``earlier`` holds the members' nodes in earlier trees: pairs that share one were compared there.
    """
    left, right = [], []
    for i in range(len(members) - 1):
        other = np.flatnonzero(labels[i + 1 :] != labels[i]) + i + 1
        if not len(other):
            continue
        rough = (sig[other, :64] == sig[i, :64]).sum(axis=1)
        other = other[rough >= least // 8 - 20]  # far from any pair that can pass
        same = (sig[other] == sig[i]).sum(axis=1)
        hit = same >= least
        hit[hit] = ~(earlier[other[hit]] == earlier[i]).any(axis=1)
        other = other[hit]
        left.append(np.full(len(other), members[i]))
        right.append(members[other])
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
    return np.minimum(a, b), np.maximum(a, b)


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two children of each (node, member), by two further selected tokens."""
    for batch in batches:
        node = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        sig, rows = _matrix(batch.column(batch.schema.get_field_index("sig"))), np.arange(batch.num_rows)
        for branch in (1, 2):
            child = mix(node * _U(0xC2B2AE3D27D4EB4F) + sig[rows, _choice(node, branch, SIGNATURE)].astype(np.uint64) + _U(branch << 32))
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *batch.columns[1:]], names=batch.schema.names)


_MEMBER = "node long, tree int, id long, label long, nodes array<long>, sig binary"


class _Join:
    def __init__(self, docs: DataFrame, width: int, percent: int, trees: int, depth: int, small: int, more_levels: int, deviations: float | None):
        self.width, self.percent, self.small, self.more_levels = width, percent, small, more_levels
        s = percent / 100
        self.least = 0 if deviations is None else max(0, math.floor(SIGNATURE * s - deviations * math.sqrt(SIGNATURE * s * (1 - s))))
        described = docs.mapInArrow(lean(_describe(width, trees, depth)), "id long, tag long, n long, d1 long, d2 long, nodes array<long>")
        self.described = cut(described)
        full = self.described.where("n > 0")
        first = F.min(F.struct("id", "tag")).alias("first")
        classes = full.groupBy("d1", "d2", "n").agg(first, F.any_value("nodes").alias("nodes"))
        self.classes = cut(classes.select("d1", "d2", "n", F.monotonically_increasing_id().alias("id"), F.col("first.id").alias("doc"), F.col("first.tag").alias("tag"), "nodes"))
        rows = self.classes.select("id", "doc", F.posexplode("nodes").alias("tree", "node"))
        stats = rows.groupBy(F.col("node").alias("of")).agg(F.count(F.lit(1)).alias("size"), F.min_by("id", "doc").alias("pivot")).where("size > 1")
        self.members = cut(rows.join(stats, F.col("node") == F.col("of")).select("node", "tree", "id", "pivot"))
        self.members = gathered(self.members, self.members.count())
        chosen = self.members.select(F.col("id").alias("chosen")).distinct()
        wanted = self.classes.join(chosen, F.col("id") == F.col("chosen"), "left_semi").select(F.col("id").alias("class"), F.col("doc").alias("wid"), F.col("tag").alias("wtag"), "nodes")
        texts = docs.join(wanted, (F.col("id") == F.col("wid")) & (F.col("tag") == F.col("wtag")))
        self.texts = cut(texts.dropDuplicates(["id", "tag"]).select(F.col("class").alias("id"), "nodes", "text"))
        self.sig = cut(self.texts.mapInArrow(lean(_sign(width)), "id long, nodes array<long>, sig binary"))
        self.links = self.labels = self.tested = None

    def agreeing(self, pairs: DataFrame) -> DataFrame:
        """(a, b, same) of pairs whose signatures agree often enough."""
        left, right = (self.sig.select(F.col("id").alias(f"{k}id"), F.col("sig").alias(f"{k}sig")) for k in "xy")
        both = pairs.join(left, F.col("a") == F.col("xid")).join(right, F.col("b") == F.col("yid")).select("a", "b", "xsig", "ysig")
        return both.mapInArrow(_agreement, "a long, b long, same long").where(F.col("same") >= self.least)

    def labelled(self, df: DataFrame, column: str, name: str) -> DataFrame:
        if self.labels is None:
            return df.withColumn(name, F.col(column))
        labels = self.labels.select(F.col("id").alias("__l"), F.col("component").alias("__c"))
        return df.join(labels, F.col(column) == F.col("__l"), "left").withColumn(name, F.coalesce("__c", column)).drop("__l", "__c")

    def confirm(self, pairs: DataFrame) -> None:
        """Test pairs of different components on their full sets, and merge those that are linked."""
        pairs = self.labelled(self.labelled(pairs.select("a", "b").distinct(), "a", "la"), "b", "lb").where("la <> lb").select("a", "b")
        if self.tested is not None:
            done = self.tested.select(F.col("a").alias("ta"), F.col("b").alias("tb"))
            pairs = pairs.join(done, (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left_anti")
        pairs = cut(pairs)
        size = pairs.count()
        if not size:
            return
        pairs = gathered(pairs, size, 20_000)
        left, right = (self.texts.select(F.col("id").alias(f"{k}id"), F.col("text").alias(f"t{k}")) for k in "ab")
        both = pairs.join(right, F.col("b") == F.col("bid")).select("a", "b", "tb").join(left, F.col("a") == F.col("aid")).select("a", "b", "ta", "tb")
        found = gathered(cut(both.mapInArrow(lean(_confirm(self.width, self.percent)), "a long, b long, linked boolean")), size)
        self.tested = found.select("a", "b") if self.tested is None else self.tested.unionByName(found.select("a", "b"))
        links = found.where("linked").select("a", "b")
        if links.isEmpty():
            return
        self.links = links if self.links is None else self.links.unionByName(links)
        self.labels = components(self.links)

    def mixed(self, rows: DataFrame) -> DataFrame:
        """(node, tree, id, label, size) of nodes with several components; ``rows`` may carry more."""
        rows = self.labelled(rows.drop("label"), "id", "label")
        stats = rows.groupBy(F.col("node").alias("of")).agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1")
        return cut(rows.join(stats, F.col("node") == F.col("of")).drop("of", "l0", "l1"))

    def exhaustive(self) -> DataFrame:
        """Candidate pairs (a, b) of all nodes with several components."""
        # the members of mixed nodes first, then their signatures
        signed = lambda rows: rows.join(sig.withColumnRenamed("id", "sid"), F.col("id") == F.col("sid")).drop("sid")
        rows = self.mixed(self.members.select("node", "tree", "id"))
        large, sig = rows.where(F.col("size") > self.small), self.sig
        some = not large.isEmpty()
        if some and self.more_levels:
            # a node that branches gets another name for each member: sharing it does not tell that a pair was compared
            branched = cut(large.groupBy(F.col("id").alias("bid")).agg(F.collect_set("tree").alias("again")))
            other = F.transform("nodes", lambda node, tree: F.when(F.array_contains("again", tree), F.col("id")).otherwise(node))
            sig = sig.join(branched, F.col("id") == F.col("bid"), "left").select("id", F.when(F.col("again").isNull(), F.col("nodes")).otherwise(other).alias("nodes"), "sig")
        leaves = [signed(rows.where(F.col("size") <= self.small))]
        if some:
            large = signed(large)
            for _ in range(self.more_levels):
                rows = self.mixed(large.select("node", "tree", "id", "label", "nodes", "sig").mapInArrow(_branch, _MEMBER).distinct())
                leaves.append(rows.where(F.col("size") <= self.small))
                large = rows.where(F.col("size") > self.small)
                if large.isEmpty():
                    break
            # nodes that stay large: every pair of blocks of members is a group of its own
            blocks = F.ceil(F.col("size") / (self.small // 2)).cast("int")
            own = F.pmod(F.xxhash64("id"), blocks).cast("int")
            with_block = large.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            leaves.append(with_block)
        parts = []
        for x in leaves:
            i, j = (F.least("block", "other"), F.greatest("block", "other")) if "block" in x.columns else (F.lit(0), F.lit(0))
            parts.append(x.select(F.struct("node", i.alias("i"), j.alias("j")).alias("cell"), "tree", "id", "label", "nodes", "sig"))
        all_ = parts[0]
        for part in parts[1:]:
            all_ = all_.unionByName(part)
        least = self.least

        def run(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            sig, tree = _matrix(table.column("sig")), table.column("tree")[0].as_py()
            nodes = np.stack(table.column("nodes").to_numpy())[:, :tree]
            a, b = _compare(table.column("id").to_numpy(), table.column("label").to_numpy(), sig, nodes, least)
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        return all_.groupBy("cell").applyInArrow(run, "a long, b long")


def _linked(docs: DataFrame, doc_id: str, text: str, width: int, percent: int, trees: int, depth: int, small: int, more_levels: int, deviations: float | None) -> tuple[DataFrame, DataFrame]:
    """(id, tag, n, component) for each row: the smallest id of the texts connected with the row's own text; and ids of several sets."""
    plain = docs.select(F.coalesce(col(doc_id).cast("long"), F.lit(LEAST)).alias("id"), F.xxhash64(col(text)).alias("tag"), col(text).alias("text"))
    join = _Join(plain, width, percent, trees, depth, small, more_levels, deviations)
    stars = join.members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    stars = cut(join.agreeing(stars))
    join.confirm(stars)
    join.confirm(join.exhaustive())
    classes = join.classes.select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.col("n").alias("cn"), F.col("id").alias("class"), "doc")
    if join.labels is None:
        classes = classes.withColumn("component", F.col("doc"))
    else:
        labels = join.labels.select(F.col("id").alias("__l"), F.col("component").alias("__c"))
        named = labels.join(join.classes.select("id", "doc"), F.col("__l") == F.col("id")).select("__l", "__c", "doc")
        heads = cut(named.groupBy(F.col("__c").alias("__h")).agg(F.min("doc").alias("head")))
        named = labels.join(heads, F.col("__c") == F.col("__h")).select("__l", "head")
        classes = classes.join(named, F.col("class") == F.col("__l"), "left").withColumn("component", F.coalesce("head", "doc"))
    classes = classes.select("c1", "c2", "cn", "component")
    found = join.described.join(classes, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")) & (F.col("n") == F.col("cn")), "left")
    ends = [f(c).alias(f"{k}_{c}") for c in ("n", "d1", "d2") for k, f in (("lo", F.min), ("hi", F.max))]
    several = join.described.groupBy(F.col("id").alias("of")).agg(*ends).where("lo_n <> hi_n or lo_d1 <> hi_d1 or lo_d2 <> hi_d2").select("of")
    return found.select("id", "tag", "n", F.coalesce("component", "id").alias("component")), several


def _one_vertex_each(rows: DataFrame, several: DataFrame) -> DataFrame:
    """``rows`` with the components united that share one of the ids ``several``."""
    several = cut(several)
    if several.isEmpty():
        return rows
    rows = cut(rows)
    edges = rows.join(several, F.col("id") == F.col("of"), "left_semi").select(F.col("id").alias("a"), F.col("component").alias("b")).where("a <> b").distinct()
    # an id of several texts and the names of their components are vertices; a name is the id of a text of its component
    labels = components(edges).select(F.col("id").alias("__l"), F.col("component").alias("__c"))
    return rows.join(labels, F.col("component") == F.col("__l"), "left").withColumn("component", F.coalesce("__c", "component"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, trees: int = 16, depth: int = 3, small: int = 2048, more_levels: int = 6, deviations: float | None = 6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row; linked are sets of similarity >= percent / 100."""
    found = _one_vertex_each(*_linked(docs, doc_id, text, width, percent, trees, depth, small, more_levels, deviations))
    back = lambda c: F.nullif(F.col(c), F.lit(LEAST))
    return found.select(back("id").alias("doc_id"), F.col("n").alias("n_shingles"), back("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, trees: int = 16, depth: int = 3, small: int = 2048, more_levels: int = 6, deviations: float | None = 6) -> DataFrame:
    """The rows of ``docs`` whose own text is connected with no text of a smaller id."""
    found, _ = _linked(docs, doc_id, text, width, percent, trees, depth, small, more_levels, deviations)
    gone = found.where("id <> component").select(F.col("id").alias("__id"), F.col("tag").alias("__tag")).distinct()
    rows = docs.select(F.struct(*[col(c).alias(c) for c in docs.columns]).alias("row"), F.coalesce(col(doc_id).cast("long"), F.lit(LEAST)).alias("id"), F.xxhash64(col(text)).alias("tag"))
    return rows.join(gone, (F.col("id") == F.col("__id")) & (F.col("tag") == F.col("__tag")), "left_anti").select("row.*")
