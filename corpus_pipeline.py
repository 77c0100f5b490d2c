"""Corpus preparation: language ID, line dedup, near-dedup, decontamination, packing.

Every stage takes the documents its predecessor kept; all but the last return the columns of
``documents``, with ``text`` and ``n_chars`` as the stage leaves them. A document that a stage
leaves without any text goes. Null ids are ids of their own; repeated rows are repeated documents.
Further columns of ``documents`` stay, whatever they are called. A stage's files are deleted when the
next stage is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import decontaminate, langid, line_dedup, near_dedup, packing
from pairlens.llm.common import apart, col, cut, remove_path, shared_path
from pairlens.llm.queries import word_tokenizer

MIN_MARGIN = 0.001  # the two smallest sizes tie, or nearly


def _with_text(out: DataFrame, columns: list[str], added: list[str], text: str) -> DataFrame:
    """``columns`` of a stage's input, in order and by their own names, with ``text`` and ``n_chars`` from the added column ``text``."""
    new = {"text": F.col(text), "n_chars": F.char_length(text).cast("long")}
    passed = [c for c in columns if c != "text"]
    names = dict(zip(passed, apart(passed, added)))
    return out.select(*[(new[c] if c in new else col(names[c])).alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without letters or between two languages go. Null ``lang`` is filled in."""
    added = ["lang_pred", "score", "rejected"]
    out = langid.identify(docs, langid.train(docs), keep=docs.columns, min_margin=MIN_MARGIN).where(~F.col("rejected"))
    kept = dict(zip(docs.columns, apart(docs.columns, added)))
    return out.select(*[(F.coalesce("lang", "lang_pred") if c == "lang" else col(kept[c])).alias(c) for c in docs.columns])


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of smaller id holds go, and documents that lose all their text."""
    out = line_dedup.dedup_lines(docs, keep=[c for c in docs.columns if c != "text"])
    left = out.where((F.col("n_dropped") == 0) | (F.btrim("kept_text", F.lit(line_dedup.STRIP)) != ""))
    return _with_text(left, docs.columns, ["n_lines", "n_dropped", "keep_bitmap", "kept_text"], "kept_text")


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by five-word similarity of 0.8 or more, the one of smallest id stays; rows of one id are judged each by its own text."""
    return near_dedup.without_near_duplicates(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that are nothing else go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    out = decontaminate.find_spans(docs, items, keep=[c for c in docs.columns if c != "text"], cleaned=True)
    left = out.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words")))
    return _with_text(left, docs.columns, ["n_words", "n_hit", "items", "spans", "clean_text"], "clean_text")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequences and offsets."""
    return packing.pack(cut(packing.tokenized(docs.select("doc_id", "text"), word_tokenizer())))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_deduplication),
    ("MinHash near-dedup", near_deduplication),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Language ID has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read by the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove_path(spark, before)
            before = path
    return docs
