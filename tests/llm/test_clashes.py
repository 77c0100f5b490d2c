"""Every operator and stage on a table that already holds every name the operators add."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairlens.llm import audio, decontaminate, langid, line_dedup, lm, near_dedup, packing, queries, sharding, substring_dedup, warc
from pairlens.llm.common import apart

SF = "/root/testdata/sf0.001"
ADDED = {
    "line_dedup": ["n_lines", "n_dropped", "keep_bitmap", "kept_text"],
    "packing": ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "audio": ["payload", "log_mel", "spans", "segments", "level", "digest"],
    "decontaminate": ["n_words", "n_hit", "items", "clean_text"],
    "langid": ["lang_pred", "score", "rejected"],
    "substring": ["n_removed"],
    "sharding": ["shard", "slot", "size", "bucket", "record", "rows"],
    "lm": ["n_tokens", "n_known", "train_tokens", "base_score"],
    "inner": ["id", "tag", "text_", "row", "__id", "__tag", "__text", "__k0", "k0", "d", "counted", "held", "chunk", "N_HIT_", "odd.name", "back`tick"],
}


@pytest.fixture(scope="module")
def full(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = [n for group in ADDED.values() for n in group]
    quote = lambda n: "`" + n.replace("`", "``") + "`"
    return docs.selectExpr("*", *[f"concat('{k}-', doc_id) as {quote(n)}" for k, n in enumerate(names)]).repartition(3).cache(), names


OPERATORS = {
    "line_dedup": lambda df: line_dedup.dedup_lines(df),
    "packing": lambda df: packing.pack(packing.tokenized(df, queries.word_tokenizer())).where("piece = 0"),
    "audio": lambda df: audio.audio_features(audio.with_wav(df.withColumn("raw", F.encode("text", "utf-8")), "raw", df.columns), "media"),
    "decontaminate": lambda df: decontaminate.find_spans(df, df.sparkSession.read.parquet(f"{SF}/benchmark.parquet"), cleaned=True),
    "decontaminate in blocks": lambda df: decontaminate.find_spans(df, df.sparkSession.read.parquet(f"{SF}/benchmark.parquet"), cleaned=True, block_bytes=5000),
    "langid": lambda df: langid.identify(df, langid.train(df)),
    "substring": lambda df: substring_dedup.remove_repeats(df),
    "sharding": lambda df: sharding.records(sharding.shuffled(df, "doc_id", "text"), df),
    "lm": lambda df: lm.score(df, "text", F.col("doc_id") % 5 != 1, F.col("doc_id") % 5 == 4, [c for c in df.columns if c != "text"]),
    "near_dedup": lambda df: near_dedup.without_near_duplicates(df, percent=100),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_operators(full, name):
    df, names = full
    out = OPERATORS[name](df)
    added = [c for c in out.columns if c not in df.columns and not c.endswith("_")] + [c for c in out.columns if f"{c}_" in out.columns]
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    back = dict(zip(names, apart(names, [a for a in added if a not in ("text",)])))
    rows = out.collect()
    assert len(rows) == (df.count() if name != "near_dedup" else near_dedup.near_duplicates(df, percent=100).where("kept").count())
    for r in rows:
        for k, n in enumerate(names):
            own = [r[c] for c in out.columns if c.rstrip("_").lower() == n.rstrip("_").lower()]
            assert f"{k}-{r['doc_id']}" in own, (n, back[n])


def test_rows_only(full):
    df, _ = full
    assert near_dedup.near_duplicates(df).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    pages = df.withColumnRenamed("doc_id", "page_id").selectExpr("*", "text as html", "'u' as url")
    assert warc._written(pages, "page_id", "url", "html").count() == df.count()


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, full, stage):
    df, names = full
    out = corpus_pipeline.STAGES[stage][1](spark, df, SF)
    rows = out.collect()
    assert rows
    if stage < 4:
        assert out.columns == df.columns
        assert all(r[n] == f"{k}-{r['doc_id']}" for r in rows for k, n in enumerate(names))


def test_names_apart():
    assert apart(["a", "A_", "b"], ["a"]) == ["a__", "A_", "b"] and apart(["N", "x"], ["n"]) == ["N_", "x"]
