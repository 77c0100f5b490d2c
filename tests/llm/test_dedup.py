"""Line, substring and near-duplicate operators against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import brute_components, brute_hits, brute_lines, brute_repeats
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlens.llm import decontaminate, exchange, line_dedup, lm, near_dedup, substring_dedup
from pairlens.llm.components import components
from pairlens.llm.substring_dedup import Chunk, Symbols

def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("table", ["odd_docs", "documents"])
def test_lines(request, table):
    docs = request.getfixturevalue(table)
    expected = brute_lines([(r.doc_id, r.text) for r in docs.collect()])
    out = line_dedup.dedup_lines(docs)
    assert rows_of(out, "doc_id", "n_lines", "n_dropped", "kept_text") == expected
    assert set(docs.columns) - {"text"} <= set(out.columns)


def test_very_common_line_spans_partitions(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "concat('the very same line in all\n', id, ' is a line of its own\nthe very same line in all') as text")
    out = rows_of(line_dedup.dedup_lines(docs), "doc_id", "n_dropped")
    assert out == sorted([(0, 0)] + [(i, 2) for i in range(1, 2000)], key=repr)


def test_bitmaps(spark):
    gone = np.array([0, 9, 17])
    keep = line_dedup.unpack_bitmap(line_dedup.pack_bitmap(gone), 100)
    assert np.flatnonzero(~keep).tolist() == gone.tolist() and len(keep) == 100


@pytest.mark.parametrize("table", ["odd_docs", "documents"])
def test_repeats(request, table):
    docs = request.getfixturevalue(table)
    expected = brute_repeats([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(substring_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_text") == expected


def test_random_repeats(spark):
    rng = np.random.default_rng(5)
    base = [" ".join(map(str, rng.integers(0, 3, 60))) for _ in range(6)]
    texts = []
    for _ in range(60):
        a, b = base[rng.integers(6)].split(), base[rng.integers(6)].split()
        texts.append(" ".join(a[rng.integers(30) : 30 + rng.integers(30)] + b[rng.integers(20) :]))
    docs = spark.createDataFrame([(int(i), t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    expected = brute_repeats([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(substring_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_text") == expected


def long_passages(seed: int, vocabulary: int) -> list[tuple[int | None, str]]:
    rng = np.random.default_rng(seed)
    words = lambda n: " ".join(map(str, rng.integers(0, vocabulary, n)))
    base = [words(n) for n in (60, 150, 400, 900)]
    rows = []
    for i in range(50):
        parts = [base[rng.integers(4)].split()[rng.integers(40) :] for _ in range(2)]
        rows.append((None if i % 17 == 3 else i // 2, " ".join([words(rng.integers(20)), *parts[0], words(rng.integers(20)), *parts[1]])))
    return rows + [(100, base[2]), (101, base[2]), (102, " ".join(["a"] * 300)), (103, " ".join(["a"] * 500))]


@pytest.mark.parametrize("vocabulary", [2, 5000])
def test_long_repeats(spark, vocabulary):
    rows = long_passages(8, vocabulary)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert rows_of(substring_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_text") == brute_repeats(rows)


def test_symbols_of_one_document_are_not_compared_further():
    one, other = (" ".join(f"{k}{i}" for i in range(900)) for k in "xy")
    chunk = Chunk(pa.RecordBatch.from_pydict({"id": pa.array([1, 2]), "text": [one, other]}), 13, 2, (8, 12))
    keys, _, values = chunk.titles
    assert len(keys) > 50 and not values[:, 1].any()
    chunk.named(np.zeros(len(keys), np.int64))
    assert not len(chunk.spans[0]) and not chunk.decided(np.zeros(0, np.int64)).any()


def test_chunks_combined_in_groups(spark, monkeypatch):
    """Results do not depend on how many chunks one call combines; a word that all chunks hold is one entry a group."""
    rows = [(d, f"every {t}") for d, t in long_passages(8, 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    score = lambda: rows_of(lm.score(docs, "text", F.col("doc_id") % 2 == 0, F.col("doc_id") % 4 == 0, ["doc_id"]), "doc_id", "n_tokens", "n_known", "train_tokens", "score")
    whole = score()
    sizes, plain = [], exchange.reduced
    monkeypatch.setattr(exchange, "FAN", 2)

    def counted(sent, combine, groups=1):
        assert groups > 1
        part = F.pmod(F.xxhash64("chunk"), F.lit(groups))
        sizes.append((groups, sent.groupBy("bucket", part).count().agg(F.max("count")).first()[0], sent.groupBy("bucket").count().agg(F.max("count")).first()[0]))
        return plain(sent, combine, groups)

    monkeypatch.setattr(lm, "reduced", counted)
    assert score() == whole
    groups, largest, undivided = sizes[0]
    assert groups >= 5 and largest < undivided and undivided >= 9
    assert rows_of(substring_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_text") == brute_repeats(rows)


def test_high_level_symbols_decide_most_of_a_long_copy():
    texts = [t for _, t in long_passages(9, 5000)[-4:-2]]
    chunk = Chunk(pa.RecordBatch.from_pydict({"id": pa.array([1, 2]), "text": texts}), 13, 2, (8, 12))
    keys, of, values = chunk.titles
    assert len(keys) < len(of) and values[:, 1].sum() > 0.8 * len(keys)
    chunk.named(values[:, 1] * np.arange(1, len(keys) + 1))
    keys, of, values = chunk.spans
    assert len(keys) < len(of) and set(values[:, 1]) == {1}
    decided = chunk.decided(values[:, 1])
    middle = chunk.at[1] // 2
    assert not decided[: chunk.at[1]].any() and decided[chunk.at[1] :].sum() > middle
    left = chunk.candidates(np.ones(len(chunk.keys), bool), decided)[1]
    assert not set(left) & set(np.flatnonzero(decided)) and set(left) | set(np.flatnonzero(decided)) == set(np.flatnonzero(chunk.windows))


@pytest.mark.parametrize("fan", [8192, 2])
def test_chunks_and_what_they_send_are_exchanged_once(spark, monkeypatch, fan):
    """Beside the chunks and the first round's results nothing is stored, with one or several groups of chunks."""
    rows = long_passages(8, 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    stored = []
    for module in (exchange, substring_dedup):
        monkeypatch.setattr(module, "cut", lambda df, plain=module.cut: stored.append(df.columns) or plain(df))
    monkeypatch.setattr(exchange, "FAN", fan)
    out = substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_text")
    assert rows_of(out, *out.columns) == brute_repeats(rows)
    assert len(stored) == 2
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    ways = 1 if fan == 8192 else 2
    assert sum("Scan ExistingRDD" in line and "payload" in line for line in plan) == 1
    assert sum("ReusedExchange" in line and "payload" in line for line in plan) == 2
    assert sum("ReusedExchange" in line and "keys" in line for line in plan) == 1 + 2 * (ways - 1)


def test_low_symbols_send_part_of_their_keys(spark, monkeypatch):
    """Half the bytes; keys that agree by chance change no result."""
    texts = [" ".join(map(str, np.random.default_rng(k).integers(0, 10**9, 4000))) for k in range(5)]
    chunk = Chunk(pa.RecordBatch.from_pydict({"id": pa.array(range(5)), "text": texts}), 13, 2, (8, 12))

    def sent(bits):
        keys, of, several = chunk.symbols(bits)
        assert len(of) == len(chunk.keys)
        return sum(len(k.as_py()) for k in exchange.slices(1, substring_dedup.LOW, keys, several, 2).column("keys"))

    assert sent(2 + substring_dedup.LOW_BITS) < 0.65 * sent(64)
    monkeypatch.setattr(substring_dedup, "LOW_BITS", 0)
    rows = long_passages(8, 5000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert rows_of(substring_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_text") == brute_repeats(rows)


def test_keys_of_two_halves_are_numbered():
    rng = np.random.default_rng(4)
    for keys, other in ((rng.integers(0, 9, 200), rng.integers(-2, 2, 200)), (np.arange(50) % 7, np.arange(50) % 7), (np.zeros(0, int), np.zeros(0, int))):
        of, n = exchange.numbered(keys.astype(np.uint64), other)
        place = {pair: k for k, pair in enumerate(sorted(set(zip(keys.tolist(), other.tolist()))))}
        assert n == len(place) and of.tolist() == [place[pair] for pair in zip(keys.tolist(), other.tolist())]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=3, max_size=25), st.lists(st.integers(0, 2), max_size=12), st.lists(st.integers(0, 2), max_size=12), st.lists(st.integers(0, 2), max_size=12))
def test_symbols_of_a_passage_recur(passage, before, left, after):
    """A symbol whose span lies in the passage is the same wherever the passage stands."""

    def parse(words):
        names = (np.array(words, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        s = Symbols(names, np.zeros(len(words), np.int64))
        for k in range(2):
            s.runs()
            s.pairs(2 * k + 1)
        return s

    def inside(words, at):
        s = parse(words)
        own = (s.low >= at) & (s.high <= at + len(passage)) & (s.low >= 0) & (s.high <= len(words))
        return set(zip(s.name[own].tolist(), (s.low[own] - at).tolist(), (s.high[own] - at).tolist()))

    assert inside(before + passage + after, len(before)) == inside(left + passage, len(left))


@pytest.mark.parametrize("table", ["odd_docs", "documents"])
def test_components_of_documents(request, table):
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for percent in (85, 80):
        assert rows_of(near_dedup.near_duplicates(docs, percent=percent), "doc_id", "n_shingles", "component_id", "kept") == brute_components(rows, percent)


def test_large_group_near_the_threshold(spark):
    """Copies with edits, some linked only through others; small nodes are forced to branch and to be cut in blocks."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        for p in rng.choice(200, rng.integers(0, 6), replace=False):
            words[p] = f"e{rng.integers(1000)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = brute_components(rows, 85)
    assert len({r[2] for r in expected}) > 1
    for small in (2048, 16):
        assert rows_of(near_dedup.near_duplicates(docs, percent=85, small=small, more_levels=2), "doc_id", "n_shingles", "component_id", "kept") == expected


def test_pairs_inside_large_families(spark):
    """Texts of one family are not linked, but share nodes that branch; copies at the threshold are linked in twos."""
    rng = np.random.default_rng(23)
    rows = []
    for i in range(80):
        order = rng.permutation(120)
        for k, chosen in enumerate((order[:60], order[17:77])):
            rows.append((2 * i + k, " ".join(f"w{x}" for x in chosen)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = brute_components(rows, 50, 1)
    assert sum(r[3] for r in expected) > 60
    assert rows_of(near_dedup.near_duplicates(docs, width=1, percent=50, trees=32, depth=1, small=8), "doc_id", "n_shingles", "component_id", "kept") == expected


def test_different_texts_of_one_id(spark):
    """Every text is compared as itself; then rows of one id are one vertex. The filter judges each row by its own text."""
    word = lambda mark, n=60: [f"{mark}{i}" for i in range(n)]
    near = lambda mark: " ".join([*word(mark), "more"])
    a, b, c, d, e = (" ".join(word(m)) for m in "abcde")
    rows = [(None, a), (None, b), (7, near("b")), (8, near("a")), (3, c), (5, c), (5, d), (9, near("d")), (5, ""), (6, e), (6, near("e")), (10, " ".join(word("f"))), (10, near("d")), (11, near("f"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(near_dedup.near_duplicates(docs, percent=80), "doc_id", "n_shingles", "component_id", "kept") == brute_components(rows, 80)
    gone = [(7, near("b")), (8, near("a")), (5, c), (9, near("d")), (10, near("d")), (11, near("f"))]
    assert rows_of(near_dedup.without_near_duplicates(docs, percent=80), "doc_id", "text") == sorted([x for x in rows if x not in gone], key=repr)


def test_components(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)] + [(2000, 2000 + i) for i in range(1, 200)]
    found = dict(rows_of(components(spark.createDataFrame(chain, "a long, b long")), "id", "component"))
    assert all(found[i] == 0 for i in range(301)) and found[1001] == 1000 and all(found[2000 + i] == 2000 for i in range(200))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(docs).count() == 0
    assert substring_dedup.remove_repeats(docs).count() == 0
    assert near_dedup.near_duplicates(docs).count() == 0


def test_hashes_are_whole(spark):
    """Words of any length are named by all their bytes."""
    import pyarrow as pa

    from pairlens.llm.common import WHITE as TABLE
    from pairlens.llm.common import text_buffers, word_names, word_spans

    long = "x" * 3_000_000
    data, at = text_buffers(pa.array([f"{long}a {long}b", f"{long}a", None, "é"]))
    starts, ends, docs = word_spans(data, at, TABLE)
    names = word_names(data, starts, ends)
    assert docs.tolist() == [0, 2, 3, 3, 4] and names[0] == names[2] and len(set(names.tolist())) == 3
    assert hashlib.sha256(data[starts[3] : ends[3]].tobytes()).hexdigest() == hashlib.sha256("é".encode()).hexdigest()
    assert defaultdict(int)[0] == 0


def thue_morse(n):
    """Two different words of n letters whose polynomials modulo a power of two agree for any base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("size", [2**10, 2**12, 2**14])
def test_words_made_to_collide(spark, size):
    one, other = thue_morse(size)
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{one} {rest}"), (2, f"{other} {rest}"), (3, f"{other} {rest} end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(substring_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_text") == brute_repeats(rows)
    assert rows_of(near_dedup.near_duplicates(docs, percent=85), "doc_id", "n_shingles", "component_id", "kept") == brute_components(rows, 85)
    found = decontaminate.find_spans(docs, spark.createDataFrame([("x", rows[0][1])], "item_id string, text string"))
    assert rows_of(found.select("doc_id", "n_hit"), "doc_id", "n_hit") == sorted([(d, h) for d, _, h, _ in brute_hits(rows, [("x", rows[0][1])])], key=repr)
    scored = lm.score(docs, "text", F.col("doc_id") == 1, F.col("doc_id") == 3, ["doc_id"])
    assert rows_of(scored, "doc_id", "n_tokens", "n_known") == [(1, 14, 14), (2, 14, 13), (3, 15, 13)]
