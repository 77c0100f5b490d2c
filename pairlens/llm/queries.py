"""The registered queries of the training-data operators, one for each, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, decontaminate, langid, line_dedup, lm, merkle, near_dedup, packing, sharding, simhash, substring_dedup, warc, whitening
from .common import crc32_mod, cut, shared_path


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


OP5_SQL = """
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(regexp_replace(lower_az, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^ ]+') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(regexp_replace(lower_az, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^ ]+')
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark)
), item_windows AS (
  SELECT DISTINCT id AS item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM words WHERE kind = 'b' AND len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT id AS doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS phrase
  FROM (SELECT id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM words, lengths WHERE kind = 'd' AND len(w) >= n)
), found AS (
  SELECT d.doc_id, d.p, d.n, i.item_id FROM doc_windows d JOIN item_windows i ON d.n = i.n AND d.phrase = i.phrase
), hits AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS k FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id
)
SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hits h ON h.doc_id = w.id LEFT JOIN items i ON i.doc_id = w.id WHERE w.kind = 'd'
"""


OP1_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (SELECT k.*, coalesce(f.first < k.doc_id, FALSE) AS gone FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that a document of smaller id also holds are dropped."""
    out = line_dedup.dedup_lines(_documents(spark, sf_dir, "doc_id", "text"), min_chars=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[p : p + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS p FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM d
  UNION
  SELECT r.x, edges.b FROM reach r JOIN edges ON r.y = edges.a
), c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 5-word shingle similarity of at least 0.85."""
    return near_dedup.near_duplicates(_documents(spark, sf_dir, "doc_id", "text"), width=5, percent=85)


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces, packed into sequences of 4096."""
    pieces = cut(packing.tokenized(_documents(spark, sf_dir, "doc_id", "text"), word_tokenizer(), end_id=1, capacity=4096))
    return packing.pack(pieces, capacity=4096)


def op4_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, padded with zero bytes to a positive multiple of 64, as 8-bit WAV and back."""
    docs = _documents(spark, sf_dir, "doc_id", "text")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = F.octet_length(raw)
    missing = F.when(size == 0, 64).otherwise((64 - size % 64) % 64)
    padded = docs.select("doc_id", size.cast("long").alias("n_bytes"), F.concat(raw, F.unhex(F.repeat(F.lit("00"), missing))).alias("payload"))
    media = audio.with_wav(padded, "payload", ["doc_id", "n_bytes"])
    described = media.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    out = audio.audio_features(described, "media")
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.concat_ws("|", F.size("spans").cast("string"), F.size("segments").cast("string"), F.format_string("%.2f", "level"), F.hex("digest")).alias("feature"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside any 10-word window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    out = decontaminate.find_spans(_documents(spark, sf_dir, "doc_id", "text"), items)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    bucket = crc32_mod("doc_id", 4)
    model = langid.train(docs.where(bucket != 2))
    out = langid.identify(docs, model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(bucket == 2, F.lit(False)).alias("held_out"), "lang_pred", F.greatest(F.lit(0.0), "score").alias("score"))


OP7_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS p FROM d WHERE len(w) >= 13)
), firsts AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(p, p + 12)) AS k FROM win JOIN firsts ON win.s = firsts.s WHERE doc_id > first
), g AS (SELECT doc_id, list(k) AS ks, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(g.n, 0) AS n_removed,
  sha256(CASE WHEN g.n IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(ks, i)), ' ') END) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every text inside a 13-word window that begins in a document of smaller id are removed."""
    out = substring_dedup.remove_repeats(_documents(spark, sf_dir, "doc_id", "text"), width=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law ``key``, in random order, with their places."""
    out = sharding.shuffled(_documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text", shards=16)
    doc_id, text = F.col("record.c0"), F.col("record.c1")
    return out.select(
        doc_id.alias("doc_id"),
        "size",
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(sharding.LAW).alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        sharding.shard_of(doc_id, 17, seed=20).cast("int").alias("grown_shard"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text under bigrams learned from documents whose crc32(doc_id) mod 5 is not 1."""
    docs = _documents(spark, sf_dir, "doc_id", "text")
    bucket = F.coalesce(crc32_mod("doc_id", 5), F.lit(1))
    out = lm.score(docs, "text", train=bucket != 1, held=bucket == 4, keep=["doc_id"])
    return out.select("doc_id", (F.coalesce(crc32_mod("doc_id", 5), F.lit(0)) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT page_id, payload, h, array_to_string(list_transform(string_split(h, ''), lambda d:
    ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', d)]), '') AS bits
  FROM p
), w AS (SELECT h, max(page_id) AS winner FROM p GROUP BY h)
SELECT b.page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
    16 * CAST(substr(bits, 5*i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5*i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5*i + 3, 1) AS INT)
    + 2 * CAST(substr(bits, 5*i + 4, 1) AS INT) + CAST(substr(bits, 5*i + 5, 1) AS INT) + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN b.page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN b.page_id = winner THEN NULL ELSE winner END AS refers_to
FROM b JOIN w ON b.h = w.h
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives with revisits and segments, and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = shared_path(spark, "warc")
    warc.write_archives(pages, path)
    back = cut(
        warc.read_archives(spark, path)
        .withColumns({"page": warc.page_of(F.col("id")), "named": warc.page_of(F.col("refers"))})
        .select(
            F.expr("try_cast(page as bigint)").alias("page_id"),
            "payload_bytes",
            F.regexp_replace("digest", "^sha1:", "").alias("payload_digest"),
            F.col("type").alias("record_type"),
            F.expr("try_cast(named as bigint)").alias("refers_to"),
        )
    )
    # a revisit's payload is that of the record it names
    sizes = back.where(F.col("record_type") == "response").groupBy(F.col("page_id").alias("named")).agg(F.max("payload_bytes").alias("named_bytes"))
    return back.join(sizes, F.col("refers_to") == F.col("named"), "left").select(
        "page_id", F.coalesce("payload_bytes", "named_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )


def _merkle_levels(nodes: str, tag: str, levels: int = 6) -> str:
    """CTEs of a tree over ``nodes`` (tree, idx, n, hash): ``{tag}r0``.. with runs, ``{tag}n1``.. with nodes, and ``{tag}ends`` with roots.

    Unrolled for trees of at most 16 ** levels leaves.
    """
    out, now = [], nodes
    for k in range(levels):
        out.append(f"{tag}r{k} AS (SELECT tree, idx // 16 AS up, max(n) AS n, list(hash ORDER BY idx) AS run FROM {now} WHERE n > 1 GROUP BY tree, idx // 16)")
        out.append(f"{tag}n{k + 1} AS (SELECT tree, up AS idx, CAST(ceil(n / 16) AS BIGINT) AS n, sha256(array_to_string(run, '')) AS hash FROM {tag}r{k})")
        now = f"{tag}n{k + 1}"
    ends = " UNION ALL ".join(f"SELECT tree, hash FROM {x} WHERE n = 1" for x in [nodes, *[f"{tag}n{k + 1}" for k in range(levels)]])
    return ", ".join([*out, f"{tag}ends AS ({ends})"])


def _merkle_path(rows: str, tag: str, levels: int = 6) -> str:
    """CTEs that lead ``rows`` (doc_id, tree, idx, folded, proof) up a tree, ending in ``{tag}p{levels}``."""
    out, now = [], rows
    for k in range(levels):
        slot = "CAST(p.at % 16 AS BIGINT)"
        out.append(f"""{tag}p{k} AS (SELECT p.doc_id, p.tree, p.at // 16 AS at,
  CASE WHEN r.run IS NULL THEN folded ELSE sha256(array_to_string(r.run[:{slot}], '') || folded || array_to_string(r.run[{slot} + 2:], '')) END AS folded,
  CASE WHEN r.run IS NULL THEN proof ELSE proof || array_to_string(r.run[:{slot}], '') || array_to_string(r.run[{slot} + 2:], '') END AS proof
  FROM {now} p LEFT JOIN {tag}r{k} r ON p.tree = r.tree AND p.at // 16 = r.up)""")
        now = f"{tag}p{k}"
    return ", ".join(out)


_LEAF = lambda text: "sha256(" + " || ".join(f"coalesce(CAST(strlen({c}) AS VARCHAR) || ':' || {c}, '-')" for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
OP11_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS source, {_LEAF('text')} AS leaf, {_LEAF("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS altered FROM documents
), s AS (
  SELECT source, count(*) AS n, CAST(row_number() OVER (ORDER BY encode(source)) - 1 AS BIGINT) AS tree FROM d GROUP BY source
), leaves AS (
  SELECT doc_id, s.tree, s.n, CAST(row_number() OVER (PARTITION BY s.tree ORDER BY doc_id) - 1 AS BIGINT) AS idx, leaf, altered FROM d JOIN s ON d.source = s.source
), l0 AS (SELECT tree, idx, n, leaf AS hash FROM leaves), {_merkle_levels('l0', 'a')},
t0 AS (SELECT CAST(0 AS BIGINT) AS tree, tree AS idx, (SELECT count(*) FROM s) AS n, hash FROM aends), {_merkle_levels('t0', 't')},
q0 AS (SELECT doc_id, tree, idx AS at, leaf AS folded, '' AS proof FROM leaves), {_merkle_path('q0', 'a')},
q1 AS (SELECT doc_id, CAST(0 AS BIGINT) AS tree, tree AS at, folded, proof FROM ap5), {_merkle_path('q1', 't')}
"""
# the altered leaves go the same way, along the original siblings
OP11_SQL = OP11_SQL + f""", b0 AS (SELECT doc_id, tree, idx AS at, altered AS folded, '' AS proof FROM leaves), {_merkle_path('b0', 'a').replace('ap', 'bp')},
b1 AS (SELECT doc_id, CAST(0 AS BIGINT) AS tree, tree AS at, folded, proof FROM bp5), {_merkle_path('b1', 't').replace('tp', 'cp')},
crc_table AS (SELECT i, list_reduce([i] || range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) t(i)), crc_list AS (SELECT list(c ORDER BY i) AS t FROM crc_table),
tampered AS (SELECT doc_id, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda c, x: xor(t[CAST(xor(c, x) & 255 AS BIGINT) + 1], c >> 8))) % 5 = 0 AS yes FROM d, crc_list)
SELECT l.doc_id, l.leaf, e.hash AS subroot, r.hash AS root, sha256(o.proof) AS proof_sha256, CASE WHEN w.yes THEN b.folded ELSE o.folded END AS folded_root,
  CASE WHEN w.yes THEN b.folded ELSE o.folded END = r.hash AS verified
FROM leaves l JOIN aends e ON l.tree = e.tree, tends r, tp5 o, cp5 b, tampered w WHERE o.doc_id = l.doc_id AND b.doc_id = l.doc_id AND w.doc_id = l.doc_id
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proofs of all documents, and which of them hold after every fifth text is tampered with."""
    docs = _documents(spark, sf_dir, "doc_id", "source", "lang", "n_chars", "text")
    columns = docs.columns
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    altered = F.when(crc32_mod("doc_id", 5) == 0, merkle.leaf_of([lowered if c == "text" else F.col(c) for c in columns]))
    out = merkle.build(docs.withColumn("altered", altered), columns, "source", "doc_id", keep=["doc_id", "altered"]).proofs()
    folded = out.withColumn("folded_root", merkle.fold(F.coalesce("altered", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under fingerprints that differ in three bits or fewer."""
    return simhash.near_duplicates(_documents(spark, sf_dir, "doc_id", "text"), most=3, width=3)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 16 whitened components of every embedding, fitted on the distinct ones."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    out = whitening.whitened(rows, "embedding", keep=["vec_id"], components=16)
    return out.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_packing": op3_packing,
        "op4_audio_features": op4_audio_features,
        "op5_decontamination": op5_decontamination,
        "op6_language_id": op6_language_id,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_sharding": op8_sharding,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_warc": op10_warc,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_simhash_near_dedup": op12_simhash_near_dedup,
        "op13_embedding_whitening": op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": OP1_SQL,
        "op2_minhash_near_dedup": OP2_SQL,
        "op5_decontamination": OP5_SQL,
        "op7_substring_dedup": OP7_SQL,
        "op10_warc": OP10_SQL,
        "op11_merkle_manifest": OP11_SQL,
    }
