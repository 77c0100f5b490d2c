"""Audio, sharding, WARC and the pipeline."""

import base64
import gzip
import hashlib
import struct
import zlib

import numpy as np
import pytest
import xxhash
from brute import WORD, brute_components, brute_hits, brute_lines
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from pairlens.llm import audio, queries, sharding, warc

SF = "/root/testdata/sf0.001"


def test_wav_of_spark_and_python_agree(spark):
    df = spark.createDataFrame([(1, b""), (2, b"abc"), (3, b"\x00\xff" * 300)], "id int, payload binary")
    rows = audio.with_wav(df, "payload", ["id", "payload"]).collect()
    for r in rows:
        assert bytes(r.media) == audio.encode_wav(bytes(r.payload)) and audio.decode_wav(bytes(r.media)) == (16000, bytes(r.payload))


def test_resampling_against_direct_convolution():
    cfg = audio.AudioConfig(up=3, down=2, taps=8)
    x = np.random.default_rng(1).normal(size=101).astype(np.float32)
    stuffed = np.zeros(len(x) * 3)
    stuffed[::3] = x
    h = audio._filters(cfg)[:, ::-1].T.reshape(-1)
    direct = np.convolve(stuffed, h)[: len(stuffed)][::2]
    assert np.allclose(audio.resample(x, cfg), direct, atol=1e-5)


def test_tone_lies_in_its_mel_band_and_segments():
    cfg = audio.AudioConfig()
    t = np.arange(16000) / cfg.rate
    tone = np.where((t > 0.3) & (t < 0.6), np.sin(2 * np.pi * 1000 * t), 0) * 100 + 128
    f = audio.features_of(tone.astype(np.uint8).tobytes(), cfg)
    loud = f["mel"][int(0.45 * cfg.out_rate / cfg.hop)]
    centre = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + cfg.out_rate / 2 / 700), cfg.mels + 2)[1:-1] / 2595) - 1)
    assert abs(centre[loud.argmax()] - 1000) < 150
    ((start, end),) = f["segments"]
    assert abs(start - 0.3) < 0.04 and abs(end - 0.6) < 0.04
    assert f["blocks"].shape[1:] == (cfg.block_frames, cfg.mels) and f["spans"][0][0] == 0 and f["spans"][-1][1] == pytest.approx(1.0)


def test_hysteresis():
    cfg = audio.AudioConfig()
    level = lambda db: 10 ** (db / 10)
    energy = np.array([level(d) for d in (-40, -16, -16, -40, -15, -3, -16, -40, 0, -40)])
    assert audio.segments(energy, cfg).tolist() == [[4, 7], [8, 9]]


def test_tensors_round_trip():
    blocks = np.arange(2 * 3 * 4, dtype=np.float32).reshape(2, 3, 4)
    assert np.array_equal(audio.tensor_array(audio.tensor_bytes(blocks)), blocks)


def test_audio_query(spark):
    rows = queries.op4_audio_features(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\0" * (64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = audio.encode_wav(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert seen.setdefault(raw, r.feature) == r.feature


def plain_features(payload, cfg):
    """Features by direct sums: zero-stuffed convolution, a Fourier matrix, triangles one at a time."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    n = cfg.taps * cfg.up
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(cfg.up, cfg.down)) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))
    h *= cfg.up / h.sum()
    stuffed = np.zeros(len(x) * cfg.up)
    stuffed[:: cfg.up] = x
    y = np.convolve(stuffed, h)[: len(stuffed)][:: cfg.down]
    frames = []
    at = 0
    while not frames or at + cfg.frame - cfg.hop < len(y):
        frames.append(np.pad(y[at : at + cfg.frame], (0, max(0, at + cfg.frame - len(y)))))
        at += cfg.hop
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(cfg.frame) / (cfg.frame - 1))
    fourier = np.exp(-2j * np.pi * np.outer(np.arange(cfg.frame), np.arange(cfg.frame // 2 + 1)) / cfg.frame)
    power = np.abs((np.array(frames) * window) @ fourier) ** 2
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, 2595 * np.log10(1 + cfg.out_rate / 2 / 700), cfg.mels + 2)]
    mel = np.zeros((len(frames), cfg.mels))
    for m in range(cfg.mels):
        for k in range(cfg.frame // 2 + 1):
            f = k * cfg.out_rate / cfg.frame
            mel[:, m] += power[:, k] * max(0.0, min((f - edges[m]) / (edges[m + 1] - edges[m]), (edges[m + 2] - f) / (edges[m + 2] - edges[m + 1])))
    energy = (np.array(frames) ** 2).sum(axis=1) / cfg.frame
    found, start, loud = [], None, False
    for k, e in enumerate([*energy, 0.0]):
        db = 10 * np.log10(max(e / energy.max(), 1e-12)) if k < len(energy) and energy.max() > 0 else -np.inf
        if db >= cfg.close_db:
            start, loud = (k if start is None else start), loud or db >= cfg.open_db
        elif start is not None:
            found += [(start, k)] if loud else []
            start, loud = None, False
    return np.log(mel + cfg.floor), found


def test_features_against_direct_sums(spark):
    cfg = audio.AudioConfig()
    rows = queries.op4_audio_features(spark, SF).orderBy("n_bytes").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows[::15]:
        raw = (texts[r.doc_id] or "").encode()
        mel, found = plain_features(raw + b"\0" * (r.payload_bytes - len(raw)), cfg)
        blocks, parts, level, digest = r.feature.split("|")
        assert (int(blocks), int(parts)) == (-(-len(mel) // cfg.block_frames), len(found))
        assert abs(float(level) - mel.mean()) < 0.0051
        assert int(digest, 16) == zlib.crc32(np.round(mel * 8).astype("<i2").tobytes())


def test_audio_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, audio.encode_wav(b""), "y"), (3, audio.encode_wav(b"\x80" * 10), "z")], "payload int, media binary, spans string")
    rows = {r[0]: r for r in audio.audio_features(df, "media", keep=["payload", "spans"]).collect()}
    assert (rows[1]["payload_"], rows[1]["spans_"]) == (1, "x")
    assert rows[1]["log_mel"] is None and rows[2]["segments"] == [] and len(audio.tensor_array(bytes(rows[3]["log_mel"]))) == 1


def test_shards_hold_the_key_law(spark, odd_docs):
    docs = odd_docs.unionByName(spark.range(100, 3000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in odd_docs.dtypes[2:]]))
    rows = sharding.shuffled(docs, "doc_id", "text", bucket_bytes=500).select(F.col("record.c0").alias("doc_id"), "record", "size", "shard", "slot", sharding.shard_of(F.col("record.c0"), 17, 20).alias("grown")).collect()
    assert len(rows) == docs.count()
    for k in range(16):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert all(r.grown in (r.shard, 16) for r in rows) and {r.shard for r in rows} == set(range(16))
    counts = np.bincount([r.shard for r in rows])
    assert counts.max() < 1.5 * counts.mean()
    ordered = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot)) if r.shard == 3 and r.doc_id]
    assert ordered != sorted(ordered)
    back = sharding.records(sharding.shuffled(docs, "doc_id", "text"), docs)
    assert back.columns == [*docs.columns, "slot", "shard"] and back.drop("slot", "shard").exceptAll(docs).isEmpty() and docs.exceptAll(back.drop("slot", "shard")).isEmpty()
    assert sharding.shuffled(docs.limit(0), "doc_id", "text").count() == 0


def brute_shard(doc_id, shards, seed=20):
    """The shard of largest hash: XXH64 of seed, shard and key in turn, each with the last hash as seed."""
    best = None
    for k in range(shards):
        h = xxhash.xxh64_intdigest(struct.pack("<i", k), xxhash.xxh64_intdigest(struct.pack("<i", seed), 42))
        h = xxhash.xxh64_intdigest(str(doc_id).encode(), h)
        h -= (h >> 63) << 64
        best = (h, -k) if best is None else max(best, (h, -k))
    return -best[1]


def test_sharding_query_against_brute_force(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op8_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert (r["size"], r.text_crc32, r.law) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "key")
        assert (r.shard, r.grown_shard) == (brute_shard(r.doc_id, 16), brute_shard(r.doc_id, 17))
    assert sorted((r.shard, r.slot) for r in rows) == [(k, i) for k in range(16) for i in range(sum(r.shard == k for r in rows))]


def test_slots_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    slots = lambda df: {(r[0], r.shard, r.slot) for r in sharding.shuffled(df, "doc_id", "text", bucket_bytes=20_000).select("record.c0", "shard", "slot").collect()}
    first = slots(docs)
    assert first == slots(docs.repartition(9)) and len(first) == docs.count()


def test_equal_rows_fill_many_buckets(spark):
    rows = spark.range(20_000).selectExpr("1L as doc_id", "'the same' as text", "map('k', id % 2) as extra")
    out = sharding.shuffled(rows, "doc_id", "text", bucket_bytes=50_000)
    sizes = [r["count"] for r in out.groupBy("bucket").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 2 * 20_000 / len(sizes)
    assert out.select("shard", "slot").distinct().count() == 20_000 and out.select("shard").distinct().count() == 1


def test_shards_are_native(spark):
    plan = queries.op8_sharding(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_shard_files(spark, tmp_path):
    docs = spark.range(500).selectExpr("id as doc_id", "repeat('x', cast(id as int)) as text")
    docs = docs.selectExpr("*", "'mine' as shard", "-doc_id as slot")
    sharding.write_shards(docs, str(tmp_path / "s"), "doc_id", "text", shards=4, bucket_bytes=20_000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 500 and back.where("shard_ = 'mine' and slot_ = -doc_id").count() == 500
    buckets = sharding.shuffled(docs, "doc_id", "text", shards=4, bucket_bytes=20_000).select("bucket").distinct().count()
    assert len(list((tmp_path / "s").glob("shard=*/*.parquet"))) == buckets > 4


@pytest.fixture(scope="module")
def odd_pages(spark):
    big = "".join(f"<p>{i} é</p>\r\n\r\nWARC/1.1\r\n" for i in range(4000))
    rows = [(1, "http://a", big), (2, None, big), (3, "u\r\nx", None), (4, "v", ""), (5, "w", "<b>€</b>"), (6, "w", "<b>€</b>"), (6, "w", "<b>€</b>"), (None, "n", "alone"), (7, "z", "q" * 16384)]
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, id string").repartition(3)


def test_archives_round_trip(spark, odd_pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(odd_pages, path, segment_bytes=1000, chunk_bytes=300, archive_records=20)
    rows = warc.read_archives(spark, path).withColumn("page", warc.page_of(F.col("id"))).collect()
    assert not [r.error for r in rows if r.error]
    html = {str(r.page_id).replace("None", "null"): (r.html or "").encode() for r in odd_pages.collect()}
    assert sorted(r.page for r in rows) == sorted([*html, "6"])
    ids = {r.id: r for r in rows}
    assert len(ids) == len(rows)
    for r in rows:
        assert r.digest == "sha1:" + base64.b32encode(hashlib.sha1(html[r.page]).digest()).decode()
        if r.type == "revisit":  # names a response of the same payload
            assert ids[r.refers].type == "response" and ids[r.refers].digest == r.digest and ids[r.refers].page == {"1": "2", "3": "4", "5": "6", "6": "6"}[r.page]
        else:
            assert r.type == "response" and bytes(r.payload) == html[r.page]
    assert sum(r.type == "response" for r in rows) == 5


def test_archives_are_members(spark, odd_pages, tmp_path):
    """Each record is a gzip member, standard tools read the whole, and the fields are those of a WARC file."""
    import gzip

    path = tmp_path / "w"
    warc.write_archives(odd_pages, str(path), segment_bytes=1000, archive_records=20)
    files = list(path.glob("part-*"))
    assert len(files) > 3 and all(f.name.endswith(".warc.gz") for f in files)
    for f in files:
        content = f.read_bytes()
        if not content:
            continue
        found = list(warc.records(gzip.decompress(content)))
        members = 0
        while content:
            coder = zlib.decompressobj(31)
            members += coder.decompress(content) != b"\r\n\r\n"
            content = coder.unused_data
        assert members == len(found)
        assert all(h["content-type"] == "application/http; msgtype=response" for h, _ in found if h["warc-type"] != "continuation")


def test_broken_segments_are_reported(spark, odd_pages, tmp_path):
    import gzip

    path, cut = tmp_path / "w", tmp_path / "cut"
    warc.write_archives(odd_pages.where("page_id = 2"), str(path), segment_bytes=50_000)
    parts = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(path.glob("part-*")))
    kept = [warc.record(f["warc-type"], [(k, v) for k, v in f.items() if k not in ("warc-type", "content-length")], b) for f, b in warc.records(parts) if f.get("warc-segment-number") != "2"]
    cut.mkdir()
    (cut / "a.warc.gz").write_bytes(gzip.compress(b"\r\n\r\n".join(kept) + b"\r\n\r\n"))
    (row,) = warc.read_archives(spark, str(cut)).collect()
    assert row.error == "segment missing or repeated" and row.payload is None


def test_damaged_files_become_error_rows(spark, tmp_path):
    import gzip

    http = lambda body: warc.HTTP + warc.chunked(body, 100)
    rec = lambda k: gzip.compress(warc.record("response", [("WARC-Record-ID", f"<urn:page:{k}>")], http(b"%d" % k)) + warc.END)
    (tmp_path / "cut.warc.gz").write_bytes(rec(1) + rec(2)[:-30])
    broken = bytearray(rec(4))
    broken[15:40] = b"\xff" * 25
    (tmp_path / "middle.warc.gz").write_bytes(rec(3) + bytes(broken) + rec(5))
    (tmp_path / "plain.warc").write_bytes(warc.record("response", [("WARC-Record-ID", "<urn:page:6>")], http(b"6")) + warc.END + b"rubbish")
    (tmp_path / "framing.warc").write_bytes(warc.record("response", [("WARC-Record-ID", "<urn:page:7>")], warc.HTTP + b"zz\r\n"))
    (tmp_path / "short.warc").write_bytes(warc.record("response", [("WARC-Record-ID", "<urn:page:8>")], http(b"8"))[:-3])
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert {(r.id, bytes(r.payload)) for r in rows if r.error is None} == {(f"<urn:page:{k}>", b"%d" % k) for k in (1, 3, 5, 6)}  # no digest: not checked
    errors = [r.error for r in rows if r.error]
    assert len(errors) >= 5 and any("cut off" in e for e in errors) and any("damaged" in e for e in errors) and any("framing" in e for e in errors)


def test_chunked_framing():
    for n in (0, 1, 299, 300, 301):
        assert warc.unchunked(warc.chunked(b"z" * n, 300)) == b"z" * n
    with pytest.raises(ValueError, match="line end"):
        warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_no_pages(spark, odd_pages, tmp_path):
    warc.write_archives(odd_pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Every stage on what its predecessor kept, against plain Python."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, found = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns and docs.where("n_chars <> char_length(text)").count() == 0
        found.append((before, {r.doc_id: r.text for r in docs.collect()} if k < 4 else docs.collect()))

    before, after = found[0]
    assert all(after[d] == before[d] for d in after) and len(after) > 0.9 * len(before)
    assert all(d not in after for d, t in before.items() if not any(c.isalpha() for c in t or ""))
    before, after = found[1]
    lines = brute_lines(list(before.items()))
    assert after == {d: t for d, _, gone, t in lines if not gone or t.strip()}
    before, after = found[2]
    heads = {d for d, _, _, kept in brute_components(list(before.items()), 80) if kept}
    assert after == {d: before[d] for d in heads}
    before, after = found[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = {d: (n, hit) for d, n, hit, _ in brute_hits(list(before.items()), items)}
    assert set(after) == {d for d, (n, hit) in hits.items() if not hit or hit < n}
    assert all(after[d] == before[d] for d in after if not hits[d][1])
    cut = [d for d in after if hits[d][1]]
    assert cut and all(len(WORD.findall(after[d])) == hits[d][0] - hits[d][1] for d in cut)  # the words that were hit went, and no others
    before, rows = found[4]
    tokenizer, pieces, used = Tokenizer.from_file(queries.word_tokenizer()), {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for d, text in before.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert pieces[d] == [(a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for a in range(0, len(ids), 4096)]
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 4096 and len(used) <= sum(used.values()) / 4096 * 1.02 + 1


def test_pipeline_of_odd_rows(spark, odd_docs, tmp_path):
    docs = odd_docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    kept = {r.doc_id for r in docs.collect()}
    assert {1, 2} & kept and not kept & {4, 5, 11}


@pytest.mark.parametrize("size", [b"-6", b"+2", b"0x2", b"1_0", b"", b"\xd9\xa2", b"f" * 17])
def test_chunk_sizes_are_hexadecimal_digits(size):
    with pytest.raises(ValueError):
        warc.unchunked(b"2\r\nab\r\n" + size + b"\r\nxxxxxxxxxxxxxxxx\r\n0\r\n\r\n")


@settings(max_examples=300, deadline=2000)
@given(st.lists(st.sampled_from([b"\r\n", b"WARC/1.0", b"0", b"a", b"-6", b";x", b"Content-Length: 3", b"WARC-Type: response", b": ", b"HTTP/1.1 200", b"Transfer-Encoding: chunked", b"\x1f\x8b\x08\x00"]), max_size=30).map(b"".join))
def test_reading_ends_on_any_bytes(data):
    """Hostile bytes end in records or ValueError, never in a loop."""
    list(warc.entries(data))
    for read in (warc.unchunked, warc.http_payload):
        try:
            read(data)
        except ValueError:
            pass


def test_reading_archives_of_others(spark, tmp_path):
    """Responses framed by length, to the end, chunked after another coding's name, and one that is no HTTP message."""
    rec = lambda k, block, *more: warc.record("response", [("WARC-Record-ID", f"<urn:page:{k}>"), *more], block) + warc.END
    digest = "sha1:" + base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    blocks = [
        rec(1, b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello", ("WARC-Payload-Digest", digest)),
        rec(2, b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nhello"),
        rec(3, b"HTTP/1.1 200 OK\r\ntransfer-encoding: gzip, Chunked\r\n\r\n5;ext=1\r\nhello\r\n0\r\nTrailer: x\r\n\r\n"),
        rec(4, b"hello", ("WARC-Segment-Number", "99999999999999999")),
        rec(5, b"hello"),
        rec(6, b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nhello"),
        rec(7, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n2\r\nab\r\n-6\r\nxxxx"),
        rec(8, b"HTTP/1.1 200 OK\r\nno end of the head"),
        warc.record("request", [("WARC-Record-ID", "<urn:page:9>")], b"GET / HTTP/1.1\r\n\r\n") + warc.END,
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, blocks)))
    rows = {r.id: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert len(rows) == 9
    for k in (1, 2, 3, 5):
        assert bytes(rows[f"<urn:page:{k}>"].payload) == b"hello" and rows[f"<urn:page:{k}>"].error is None
    assert all(rows[f"<urn:page:{k}>"].error for k in (4, 6, 7, 8))
    assert rows["<urn:page:9>"].type == "request" and rows["<urn:page:9>"].error is None
