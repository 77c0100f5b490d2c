"""Decontamination, language ID, language model, packing."""

import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from brute import LOWER, WORD, brute_hits
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from pairlens.llm import decontaminate, langid, lm, packing, queries
from pairlens.llm.common import lean
from pairlens.llm.fm_index import SEPARATOR, FMIndex



@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(2, 4), min_size=1, max_size=5))
def test_fm_index(text, pattern):
    s = np.array([*text, SEPARATOR], np.int64)
    index = FMIndex(s, 5, sample=3)
    low, high = index.search(np.array([pattern]), np.array([len(pattern)]))
    found = sorted(index.locate(np.arange(low[0], max(low[0], high[0]))).tolist())
    assert found == [i for i in range(len(s)) if s[i : i + len(pattern)].tolist() == pattern]


def test_fm_index_of_repeats():
    s = np.array(([2, 3, 2, 3] * 50 + [SEPARATOR]) * 20, np.int64)
    index = FMIndex(s, 4)
    low, high = index.search(np.array([[2, 3, 2, 3, 2, 3], [3, 2, 2, 0, 0, 0]]), np.array([6, 3]))
    assert high[0] - low[0] == 20 * 98 and high[1] <= low[1]
    assert set((index.locate(np.arange(low[0], high[0])) % 201 % 2).tolist()) <= {0, 1}


@pytest.mark.parametrize("table", ["odd_docs", "documents"])
@pytest.mark.parametrize("block", [4 << 20, 300])
def test_decontamination(spark, request, table, block):
    docs = request.getfixturevalue(table)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(8).select("item_id", "text", F.lit(1).alias("n_words"))
    extra = [(100, "WORD3 word4, word5"), (101, None), (102, ""), (None, "x y x y x y x y x y x"), (103, "a a a"), (103, "é ü"), (104, " ".join(f"word{i}" for i in range(25)))]
    items = items.unionByName(spark.createDataFrame([(*e, 1) for e in extra], "item_id long, text string, n_words int"))
    expected = brute_hits([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    out = decontaminate.find_spans(docs, items, cleaned=True, shard_bytes=2000, block_bytes=block)
    got = out.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got), key=repr) == expected
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit
        assert len(WORD.findall((r.clean_text or "").translate(LOWER))) == r.n_words - r.n_hit


def test_one_block_is_held_at_a_time(spark, documents):
    """A test set of many blocks is broadcast one block after another, each given up after its pass."""
    from unittest.mock import patch

    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    whole = decontaminate.find_spans(documents, items).select("doc_id", "n_hit", "items", "spans")
    held, most, context = set(), 0, type(spark.sparkContext)
    broadcast = context.broadcast

    def counted(self, value):
        nonlocal most
        shared = broadcast(self, value)
        destroy = shared.destroy
        held.add(id(shared))
        most = max(most, len(held))
        shared.destroy = lambda *a: (held.discard(id(shared)), destroy(*a))
        return shared

    with patch.object(context, "broadcast", counted):
        parts = decontaminate.find_spans(documents, items, block_bytes=2000)
    assert most == 1 and not held
    assert sorted(map(repr, parts.select(*whole.columns).collect())) == sorted(map(repr, whole.collect()))


def test_decontamination_of_nothing(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_spans(documents, none).where("n_hit > 0").count() == 0
    assert decontaminate.find_spans(documents.limit(0), none).count() == 0


def test_language_id_on_held_out_rows(spark):
    out = queries.op6_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = out.join(docs, "doc_id").where("held_out and lang_pred <> 'und'").selectExpr("count(*) as n", "count_if(lang = lang_pred) as ok", "min(score) as lo", "max(score) as hi").first()
    assert held.n > 200 and held.ok / held.n > 0.95 and 0 <= held.lo <= held.hi <= 1


def test_language_id_against_brute_force(spark, documents):
    """Every text compressed with every dictionary, one at a time."""
    import zstandard

    model = langid.train(documents)
    letters = regex.compile(r"[\p{L}\p{M}]+")
    rows = {r.doc_id: r for r in langid.identify(documents, model, keep=["doc_id"]).collect()}
    for d in documents.collect():
        data = " ".join(letters.findall((d.text or "").lower())).encode()
        if not regex.search(r"\p{L}", d.text or ""):
            assert (rows[d.doc_id].lang_pred, rows[d.doc_id].rejected) == ("und", True)
            continue
        sizes = {}
        for lang, content in model.items():
            coder = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(coder.compress(data[k : k + langid.PIECE])) for k in range(0, len(data), langid.PIECE))
        first, second = sorted(sizes.values())[:2]
        assert sizes[rows[d.doc_id].lang_pred] == first and rows[d.doc_id].score == pytest.approx(1 - first / second)


def test_language_of_long_texts_only(spark):
    """A language all of whose training texts are long is learned; marks stay with their letters."""
    rng = np.random.default_rng(4)
    text = lambda words, n: " ".join(rng.choice(words, n))
    english, hindi = "the house of a river and stone with many green trees".split(), "हिन्दी भाषा में लिखा हुआ यह एक वाक्य है".split()
    rows = [(k, text(english, 40), "en") for k in range(20)] + [(100 + k, text(hindi, 9000), "hi") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert set(model) == {"en", "hi"} and all(0 < len(v) <= langid.DICT_BYTES for v in model.values()) and "हिन्दी".encode() in model["hi"]
    probe = spark.createDataFrame([(1, text(hindi, 30)), (2, text(english, 30))], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(probe, model).collect()} == {1: "hi", 2: "en"}


def test_copies_do_not_fill_a_dictionary(spark):
    """Many copies of one text are one training text, wherever its hash puts it; labels are still ordered by rows."""
    texts = [f"text number {k} of " + " ".join(f"w{k}x{i}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(200)) for k in range(6)]
    for copied in texts:
        rows = [(t, "aa") for t in texts for _ in range(200 if t == copied else 1)] + [("andere sprache hier", "bb")] * 100
        docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
        model = langid.train(docs, dict_bytes=16 << 10)
        assert list(model) == ["aa", "bb"] and model["bb"] == b"andere sprache hier"
        assert sorted(model["aa"].split(b"\n")) == sorted(langid.plain(t) for t in texts)


def test_training_against_brute_force(documents):
    """A dictionary is the first distinct texts in hash order that fill it, the first one last."""
    size = 8 << 10
    rows = documents.where("lang is not null and octet_length(text) between 1 and 1024").select("lang", "text", F.xxhash64(F.lit(17), "text").alias("rank"))
    expected, count = {}, defaultdict(int)
    texts = defaultdict(set)
    for r in rows.collect():
        count[r.lang] += 1
        texts[r.lang].add((r.rank, r.text))
    for lang, ranked in texts.items():
        taken, held = [], 0
        for _, text in sorted(ranked):
            if held >= size:
                break
            taken.append(text)
            held += len(text.encode())
        expected[lang] = b"\n".join(langid.plain(x) for x in reversed(taken))[-size:]
    model = langid.train(rows.repartition(7), dict_bytes=size)
    assert len(expected) > 1 and model == expected
    assert list(model) == sorted(model, key=lambda k: (-count[k], k))


def test_columns_that_are_no_languages_are_refused(spark):
    docs = spark.range(30).selectExpr("id as doc_id", "'some text' as text", "concat('l', id) as lang")
    assert len(langid.train(docs, max_labels=30)) == 30
    with pytest.raises(ValueError, match="30 distinct labels"):
        langid.train(docs, max_labels=29)


def test_language_id_of_odd_rows(spark, odd_docs):
    model = langid.train(odd_docs)
    assert set(model) == {"en", "de"}
    rows = {(r.doc_id, r.tag): r for r in langid.identify(odd_docs, model, min_margin=0.001).collect()}
    assert all(rows[k].lang_pred == "und" and rows[k].rejected for k in rows if k[0] in (4, 5, 11))
    assert len(rows) == odd_docs.count()
    nothing = langid.identify(odd_docs, langid.train(odd_docs.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert langid.identify(odd_docs.limit(0), model).count() == 0


def test_language_id_of_a_very_long_text(spark):
    """A clean text of many megabytes has a clear margin."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    english = "\n".join(r.text for r in docs.where("lang = 'en' and text is not null").orderBy("doc_id").collect())
    assert len(english) > 100_000
    text = "\n".join(" ".join(np.random.default_rng(k).permutation(english.split())) for k in range(8 * 10**6 // len(english)))
    rows = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    (row,) = langid.identify(rows, langid.train(docs), min_margin=corpus_pipeline.MIN_MARGIN).collect()
    assert row.lang_pred == "en" and not row.rejected and row.score > 0.005


def brute_model(rows, train, held):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["</s>"] for _, t in rows]

    def counts(choose):
        one, two = Counter(), Counter()
        for (d, _), w in zip(rows, tokens):
            if choose(d):
                one.update(w)
                one["<s>"] += 1
                two.update(zip(["<s>", *w], w))
        return one, two

    a1, a2 = counts(lambda d: train(d) and not held(d))
    c1, c2 = counts(train)
    vocabulary = sum(1 for k, n in c1.items() if n and k != "<s>")
    n_a, n = sum(a1.values()) - a1["<s>"], sum(c1.values()) - c1["<s>"]
    events = [[] for _ in range(24)]  # exact (p2, p1) of held-out tokens by context bucket
    bucket = lambda n: min(n.bit_length(), 23)
    for (d, _), w in zip(rows, tokens):
        if train(d) and held(d):
            for v, x in zip(["<s>", *w], w):
                events[bucket(a1[v])].append((a2[v, x] / max(a1[v], 1), a1[x] / max(n_a, 1)))
    weights = []
    for k, own in enumerate(events):
        w2, w1, w0 = (0.0, 0.999, 0.001) if k == 0 else (0.4, 0.599, 0.001)
        if not own and k > 1 and any(events):
            w2, w1, w0 = weights[-1]
        for _ in range(60 if own else 0):
            sums = [0.0, 0.0, 0.0]
            for p2, p1 in own:
                parts = (w2 * p2, w1 * p1, w0 / (vocabulary + 1))
                for i in range(3):
                    sums[i] += parts[i] / sum(parts)
            sums = [max(s / len(own), 0.0 if k == 0 and i == 0 else 1e-6) for i, s in enumerate(sums)]
            w2, w1, w0 = (s / sum(sums) for s in sums)
        weights.append((w2, w1, w0))

    def p(v, x):
        w = weights[bucket(c1[v])]
        return w[0] * c2[v, x] / max(c1[v], 1) + w[1] * c1[x] / max(n, 1) + w[2] / (vocabulary + 1)

    base = [sum(math.log10((c1[x] + 0.5) / (n + 0.5 * (vocabulary + 1))) for x in w) for w in tokens]
    full = [sum(math.log10(p(v, x)) for v, x in zip(["<s>", *w], w)) for w in tokens]
    known = [sum(c1[x] > 0 for x in w) for w in tokens]
    return tokens, known, n, base, full, p, c1


@pytest.mark.parametrize("table", ["odd_docs", "documents"])
def test_language_model(spark, request, table):
    docs = request.getfixturevalue(table).where("doc_id is not null").dropDuplicates(["doc_id"]).limit(60)
    docs = docs.cache()
    rows = sorted((r.doc_id, r.text) for r in docs.collect()) if table == "documents" else [(r.doc_id, r.text) for r in docs.collect()]
    crc = lambda d, m: zlib.crc32(str(d).encode()) % m
    tokens, known, n, base, full, p, c1 = brute_model(rows, lambda d: crc(d, 5) != 1, lambda d: crc(d, 5) == 4)
    bucket = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    got = {r.doc_id: r for r in lm.score(docs, "text", bucket != 1, bucket == 4, ["doc_id"]).collect()}
    for (d, _), w, k, b, f in zip(rows, tokens, known, base, full):
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), k, n)
        assert r.base_score == pytest.approx(b, rel=1e-9) and r.score == pytest.approx(f, rel=5e-3)  # weights come from rounded probabilities
    words = [x for x in c1 if x != "<s>"]
    for v in ["<s>", words[0], words[len(words) // 2]]:
        if v != "</s>":
            assert sum(p(v, x) for x in words) + p(v, "never seen") == pytest.approx(1, abs=1e-6)


def test_language_model_without_training(spark, odd_docs):
    no = F.lit(False)
    rows = lm.score(odd_docs, "text", no, no, ["doc_id"]).collect()
    assert len(rows) == odd_docs.count() and all(r.score == 0 and r.n_known == 0 for r in rows)
    assert lm.score(odd_docs.limit(0), "text", no, no, ["doc_id"]).count() == 0


def test_word_encoder_equals_the_tokenizer(documents):
    path = queries.word_tokenizer()
    encoder, whole = packing.WordEncoder(path), packing.TextEncoder(path)
    texts = [r.text for r in documents.collect()]
    texts += [None, "", "don't STOP\x1cnow <|endoftext|>a<|ENDOFTEXT|> É 'S ''ll", "İstanbul Σας 123 1a2b\x85c", "ﬁ é a​b a<|b", "a… b…!! c€ € €€ d€. é́.. ½! ²?? x's!! o''. 'tis. --a-- _b_ ⅷ. ª."]
    assert encoder.encode(texts) == whole.encode(texts)


def test_word_encoder_on_every_code_point():
    """Each code point after a letter and alone, before punctuation, and random mixes with marks and apostrophes."""
    path = queries.word_tokenizer()
    encoder, whole = packing.WordEncoder(path), packing.TextEncoder(path)
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}! {c}." for c in points[k : k + 400]) for k in range(0, len(points), 400)]
    rng = np.random.default_rng(8)
    letters = [*"aZ\u00e9\u0130\u095c\u095d\u09df\u0a5b\ufb1d\ufb2a\u0301\u0307\u093c\u09bc\u1161\u11a8\uac00\u03a3\u200d\u20ac5\u0661\u2167", *"'!.,;-<=>", "'s", "'ll", "\u0338"]
    texts += [" ".join("".join(rng.choice(letters, size=rng.integers(1, 7))) for _ in range(40)) for _ in range(500)]
    texts += ["\u09b9\u09df, \u092a\u0939\u093e\u095c, \u0917\u095d. EV\u0130, \ufb2a!"]
    for text, own, right in zip(texts, encoder.encode(texts), whole.encode(texts)):
        if own != right:
            bad = [w for w in text.split() if encoder.encode([w]) != whole.encode([w])]
            raise AssertionError(bad[:5] or text[:80])


def test_tokenizer_files_choose_their_encoder(spark):
    """A file whose tokens reach across blanks is not taken apart at blanks."""
    import public_tokenizers
    from tokenizers import Tokenizer

    byte_level = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.parts_at_blanks(queries.word_tokenizer()) and not packing.parts_at_blanks(byte_level)
    docs = spark.createDataFrame([(1, "hello world"), (2, "a [PAD] b"), (3, "A  b\n")], "doc_id long, text string")
    rows = packing.tokenized(docs, byte_level, end_id=50256, with_ids=True).collect()
    for r, text in zip(sorted(rows, key=lambda r: r.doc_id), ("hello world", "a [PAD] b", "A  b\n")):
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*Tokenizer.from_file(byte_level).encode(text, add_special_tokens=False).ids, 50256]


def test_workers_drop_the_tokenizer_before_other_tasks(spark, documents):
    def probe(batches):
        import gc

        import pyarrow as pa

        from pairlens.llm.packing import WordEncoder

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(isinstance(x, WordEncoder) for x in gc.get_objects())], pa.int64())], names=["n"])

    def most(**kind):
        return spark.range(0, 64, 1, 16).mapInArrow(lean(probe, **kind), "n long").agg(F.max("n").alias("n")).first().n

    tokenize = lambda: packing.tokenized(documents.repartition(16), queries.word_tokenizer()).count()
    tokenize()
    assert most() == 0
    tokenize()
    assert most(kind="tokenizing") == 1  # kept for the next task of its own kind


def test_packing(spark, odd_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.word_tokenizer())
    pieces = packing.tokenized(odd_docs, queries.word_tokenizer(), with_ids=True).cache()
    rows = packing.pack(pieces).collect()
    assert len(rows) == pieces.count()
    texts = {r.tag: r.text for r in odd_docs.collect()}
    for tag, text in texts.items():
        own = sorted((r for r in rows if r.tag == tag), key=lambda r: r.piece)
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in own]).tolist() == ids
        assert [r.length for r in own[:-1]] == [4096] * (len(own) - 1) and [r.start for r in own] == [4096 * k for k in range(len(own))]
        assert all(zlib.crc32(r["ids"]) == r.ids_crc32 for r in own)
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 4096


def best_fit_decreasing(counts, capacity):
    gaps = []
    for x in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= x]
        if fits:
            i = min(fits, key=gaps.__getitem__)
            gaps[i] -= x
        else:
            gaps.append(capacity - x)
    return len(gaps)


@settings(max_examples=300, deadline=None)
@example({1: 1, 2: 1, 16: 12, 33: 12})
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plans(counts):
    plan = packing.Plan(counts, 64)
    used = Counter()
    for lengths, times in plan.patterns:
        assert sum(lengths) <= 64 and times > 0
        for x in lengths:
            used[x] += times
    assert used == Counter(counts)
    assert -(-sum(k * n for k, n in counts.items()) // 64) <= plan.sequences <= best_fit_decreasing(counts, 64)


def test_exact_complements_beat_best_fit():
    """Pairs and triples that fill a sequence exactly are found through their sums."""
    assert packing.Plan({60: 3, 40: 3, 50: 1, 30: 1, 20: 1}, 100).sequences == 4
    counts = {7: 4, 5: 4, 4: 8, 3: 4}  # 7 + 3 and 5 + (4, 4 left for one another)
    assert packing.Plan(counts, 13).sequences <= best_fit_decreasing(counts, 13)
    assert packing.Plan({26: 2, 25: 2, 24: 1, 21: 2, 20: 2, 17: 1}, 62).sequences == 4


def test_plan_of_many_lengths_is_quick():
    rng = np.random.default_rng(3)
    counts = Counter(np.minimum(4096, rng.lognormal(6, 1.3, 200_000).astype(int) + 1).tolist())
    began = time.perf_counter()
    plan = packing.Plan(counts, 4096)
    assert time.perf_counter() - began < 5 and plan.sequences <= -(-sum(k * n for k, n in counts.items()) // 4096) * 1.001 + 1


def test_packing_of_one_common_length(spark):
    pieces = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 7L, 1000L + id % 50) as length", "'x' as offset2", "id as n")
    rows = packing.pack(pieces).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3000
    assert packing.pack(pieces.limit(0)).count() == 0
