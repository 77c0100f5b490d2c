"""Merkle manifest, SimHash links and whitening against brute force."""

import hashlib
import math
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlens.llm import merkle, queries, simhash, whitening

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
LOWER = {k: k + 32 for k in range(65, 91)}


def brute_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(hashes, slots):
    """Root, and for each leaf its siblings level by level with its slot."""
    paths, level, at = [[] for _ in hashes], list(hashes), list(range(len(hashes)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // slots * slots : i // slots * slots + slots]
            paths[k].append((i % slots, run))
        level = [sha("".join(level[i : i + slots])) for i in range(0, len(level), slots)]
        at = [i // slots for i in at]
    return level[0], paths


def brute_manifest(rows, slots=16):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root) of each row; rows are tuples of COLUMNS."""
    first = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    ends, placed = [], []
    for g in order:
        own = sorted(groups[g], key=lambda r: (first(r[0]), brute_leaf(r)))
        root, paths = brute_tree([brute_leaf(r) for r in own], slots)
        placed.append((own, paths))
        ends.append(root)
    root, tops = brute_tree(ends, slots)
    out = []
    for (own, paths), sub, top in zip(placed, ends, tops):
        for r, path in zip(own, paths):
            whole = path + top
            folded = brute_leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                folded = brute_leaf([*r[:4], None if r[4] is None else r[4].translate(LOWER)])
            for slot, run in whole:
                folded = sha("".join([*run[:slot], folded, *run[slot + 1 :]]))
            proof = sha("".join(x for slot, run in whole for i, x in enumerate(run) if i != slot))
            out.append((r[0], brute_leaf(r), sub, root, proof, folded))
    return sorted(out, key=repr)


def proofs(df, slots=16):
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.leaf_of([F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c == "text" else F.col(c) for c in COLUMNS]))
    out = merkle.build(df.withColumn("altered", altered), COLUMNS, "source", "doc_id", ["doc_id", "altered"], slots).proofs()
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256), merkle.fold(F.coalesce("altered", "leaf"), F.col("path")))
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("slots", [2, 3, 16])
def test_manifest(spark, odd_docs, slots):
    few = odd_docs.select(*COLUMNS)
    # null and several sources, one of a single row, one that needs three levels, repeated rows
    more = spark.range(70).selectExpr("id % 61 as doc_id", "case when id < 40 then 'é' when id = 40 then 'Z' when id = 41 then null else concat('s', id) end as source", "'en' as lang", "id % 61 as n_chars", "concat('Text ', id % 61) as text")
    rows = few.unionByName(more).repartition(4)
    assert proofs(rows, slots) == brute_manifest([tuple(r) for r in rows.collect()], slots)


def test_manifest_small(spark):
    rows = spark.createDataFrame([(1, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    assert proofs(rows) == brute_manifest([(1, None, None, None, None)])
    assert proofs(rows)[0][4] == sha("") and proofs(rows)[0][1] == proofs(rows)[0][3]
    assert proofs(rows.where("false")) == []


def test_manifest_hot_and_equal(spark):
    """One source with nearly all rows, most of which repeat, and very many small sources."""
    rows = spark.range(3000).selectExpr("case when id < 2000 then 7 else id end as doc_id", "case when id < 2500 then 'hot' else concat('s', id) end as source", "'x' as lang", "1L as n_chars", "'same' as text")
    assert proofs(rows) == brute_manifest([tuple(r) for r in rows.collect()])


def test_manifest_columns_and_nodes(spark, documents):
    names = ["leaf", "SUBROOT", "path", "root", "tree", "idx", "kept", "order", "group", "t"]
    rows = documents.limit(50).select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    built = merkle.build(rows, COLUMNS, "source", "doc_id", keep=rows.columns)
    out = built.proofs().collect()
    assert len(out) == 50 and all(r["leaf_"] == 0 and r["SUBROOT_"] == 1 and r["tree"] == 4 and r["t"] == 9 for r in out)
    nodes = built.nodes().collect()
    assert built.root in {r.hash for r in nodes if r.tree == merkle.TOP}
    changed = merkle.build(rows.withColumn("text", F.concat("text", F.when(F.col("doc_id") == 3, "!").otherwise(""))), COLUMNS, "source", "doc_id")
    assert changed.root != built.root


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text, width=3):
    words = WORDS.findall((text or "").translate(LOWER))
    some = [" ".join(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in some]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_links(points, most):
    return {(a, b) for a, b in combinations(sorted(points), 2) if bin(a ^ b).count("1") <= most}


def brute_classes(rows, most=3):
    marked = [(d, brute_fingerprint(t)) for d, t in rows]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for d, f in marked:
        if d is not None:
            parent[find(("id", d))] = find(f)
        find(f)
    for a, b in brute_links({f for _, f in marked}, most):
        parent[find(a)] = find(b)
    least = {}
    for d, f in marked:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in marked), key=repr)


@pytest.mark.parametrize("table", ["odd_docs", "documents"])
def test_simhash(request, table):
    docs = request.getfixturevalue(table)
    out = simhash.near_duplicates(docs)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_simhash_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab AB\t\n\x0b\x1cé "), max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 701} v{i}" for i in range(700))
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def signed(points):
    return [(p - (1 << 64) if p >> 63 else p,) for p in points]


@pytest.mark.parametrize("most", [0, 1, 3, 4])
def test_links(spark, most):
    """Random points, clusters of near ones at every distance, constant and correlated bits."""
    rng = np.random.default_rng(most)
    points = {0, 2**64 - 1}
    for _ in range(40):
        base = int(rng.integers(0, 2**63)) & ~(0xFFFF << 16) | int(rng.integers(2)) * 0x7F  # bits that never vary and some that go together
        for _ in range(12):
            flips = rng.choice(64, size=int(rng.integers(0, 7)), replace=False)
            points.add(base ^ sum(1 << int(f) for f in flips))
    df = spark.createDataFrame(signed(points), "point long").repartition(3)
    got = {tuple(sorted(x & (2**64 - 1) for x in r)) for r in simhash.links(df, most).collect()}
    assert got == brute_links(points, most)


def test_links_of_one_ball(spark):
    """All points within two bits of one: every partition's values are common, and no link is lost."""
    points = {sum(1 << i for i in some) for n in range(3) for some in combinations(range(64), n)}
    df = spark.createDataFrame(signed(points), "point long").repartition(3)
    got = simhash.links(df, 3).selectExpr("count(*) as n", "count(distinct a, b) as d").first()
    assert got.n == got.d == len(brute_links(points, 3))


def test_thresholds():
    """Thresholds add up, cost least of all allocations, and avoid partitions of common values."""
    rng = np.random.default_rng(3)
    points = rng.integers(0, 2**63, size=4000, dtype=np.uint64) & np.uint64(0xFFFFFFFFFFFF0000)
    both = np.zeros((64, 64), np.int64)
    bits = simhash._bits(points).astype(np.int64)
    both += bits.T @ bits
    blocks = simhash.grouped(simhash.correlations(both, len(points)), [8] * 8)
    shape = simhash.Scheme(blocks, [], np.zeros(0), len(points), 3)
    values = shape.values(points)
    counted = np.stack([np.bincount(values[:, b], minlength=256) for b in range(8)])
    for parts in (2, 3, 4):
        scheme = simhash._scheme(both, len(points), counted, 3, parts, blocks)
        limits, cost = scheme.thresholds(values[:50])
        assert (limits.sum(axis=1) == 3 - parts + 1).all() and limits.min() >= -1
        costs = scheme.costs(values[:50])
        ways = [w for w in np.ndindex(*[5] * parts) if sum(w) == 4]
        least = np.min([sum(costs[:, k, u] for k, u in enumerate(w)) for w in ways], axis=0)
        assert np.allclose(cost, least)
        exact = [sum(bin(int(scheme.keys(values[:1], p)[0] ^ x)).count("1") <= 1 for x in scheme.keys(values, p)) for p in range(parts)]
        estimated = costs[0, :, 2] - [1 + 8 * len(b) for b in scheme.parts]
        assert all(math.isclose(a, b, abs_tol=max(3, 0.25 * b)) for a, b in zip(estimated, exact))


def brute_whitening(rows, components=16):
    vectors = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    grid = [(k, tuple(math.floor(64 * float(c)) + 1000000 for c in v)) for k, v in vectors]
    points = sorted({x for _, x in grid})
    n, x = len(points), np.array(points, dtype=np.int64)
    sums = [int(s) for s in x.sum(axis=0)]
    centred = x - np.array(sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    out = {}
    for k, v in grid:
        exact = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        for c in range(min(components, len(sums))):
            out.setdefault((k, c + 1), []).append((exact, float((np.array(v) - np.array(sums) / n) @ axes[:, c] / math.sqrt(values[c])), float(values[c] / np.trace(centred.T @ centred / n))))
    return n, out


@pytest.mark.parametrize("slab_rows", [1 << 25, 90])
def test_whitening(spark, slab_rows):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label")
    given_rows = [(r.vec_id, r.embedding) for r in rows.collect()]
    n, expected = brute_whitening(given_rows)
    out = whitening.whitened(rows, "embedding", ["vec_id", "label"], slab_rows=slab_rows).collect()
    assert len(out) == sum(map(len, expected.values())) and {r.n for r in out} == {n}
    turns = {}
    for r in out:
        exact, y, share = expected[r.vec_id, r.component][0]
        assert int(r.deviation) == exact and math.isclose(r.explained, share, rel_tol=1e-9)
        if abs(y) > 1e-3:
            turns.setdefault(r.component, set()).add(round(r.whitened / y, 6))
        assert math.isclose(abs(r.whitened), abs(y), abs_tol=1e-7)
        assert r.identity_error < 1e-9
    assert all(t in ({1.0}, {-1.0}) for t in turns.values()) and len(turns) == 16


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(c) for c in rng.normal(size=4)], i) for i in range(40)]
    hot = [(100 + i, good[0][1], None) for i in range(300)]
    odd = [(900, None, 1), (901, [1.0, None, 2.0, 3.0], 1), (902, [math.nan, 0.0, 0.0, 0.0], 1), (903, [math.inf, 0.0, 0.0, 0.0], 1), (904, [], 1), (905, [1.0, 2.0], 1), (None, good[1][1], 1), (906, [1e300, 0.0, 0.0, 0.0], 1), (907, [1e3, 0.0, 0.0, 0.0], 1)]
    rows = spark.createDataFrame(good + hot + odd, "vec_id long, embedding array<double>, component long").repartition(5)
    n, expected = brute_whitening([(k, v) for k, v, _ in good + hot] + [(None, good[1][1]), (907, odd[-1][1])])
    out = whitening.whitened(rows, "embedding", ["vec_id", "component"]).collect()
    assert n == 41 and len(out) == 4 * (40 + 300 + 2)
    for r in out:
        exact, y, _ = expected[r.vec_id, r.component][0]
        assert int(r.deviation) == exact and math.isclose(abs(r.whitened), abs(y), rel_tol=1e-6, abs_tol=1e-6)
        assert r["component_"] == (r.vec_id if r.vec_id is not None and r.vec_id < 40 else 1 if r.vec_id in (None, 907) else None)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_whitening_without_components(spark, rows):
    out = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "embedding", ["vec_id"])
    assert out.collect() == [] and out.columns == ["vec_id", "n", "deviation", "component", "whitened", "explained", "identity_error"]


def test_queries(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS).collect()]
    out = queries.op11_merkle_manifest(spark, SF).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in out), key=repr) == brute_manifest(docs)
    assert all(r.verified == (r.folded_root == r.root) for r in out) and {r.verified for r in out} == {True, False}
    assert dict(queries.op13_embedding_whitening(spark, SF).dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert dict(queries.op12_simhash_near_dedup(spark, SF).dtypes) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
