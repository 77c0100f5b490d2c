"""Language ID by compression.

Every language has a raw-content zstandard dictionary made of training texts. A text is compressed
with each dictionary; the language that makes it smallest wins. A text whose best and second-best
size hardly differ is rejected. Before either step a text is lower-cased and every run of other
characters than letters becomes one space, so that capitals, markup and punctuation do not decide.

Training: the distinct texts of a label are put in the order of a seeded hash and the first ones
are taken until its dictionary holds ``dict_bytes``, so copies of a text do not fill it, however many
there are; of a training text longer than
``dict_bytes // 8`` one piece of that length is taken, at a hashed place, so that one text cannot be
the dictionary and every label has one. This bounded sample is the only thing sent to the driver: at
most ``dict_bytes`` for each distinct label. Every label costs a dictionary on the driver and in each
task, and a compression of each text, so a column of more than ``max_labels`` distinct labels is refused
with a ValueError: it holds something else than languages.

Defined results: a null text, an empty one and one without a letter get ``und`` (size ratio 0,
rejected). Ties go to the label with the most training rows, then to the one that sorts first. If no
labelled row exists every text is ``und``. Rows with null ids, repeated rows and further columns pass
through; a column that bears the name of an added one gets ``_`` appended. Texts longer than ``PIECE`` bytes
are compressed in pieces that each start from the dictionary, and the sizes are summed: all of the
text counts, and the margin between two languages does not shrink with its length.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, col, lean

UNKNOWN = "und"
DICT_BYTES = 96 << 10
MAX_LABELS = 1000
PIECE = 32 << 10
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


#: ASCII letters stay, in lower case; all else becomes a space
_ASCII = bytes(b if chr(b).isascii() and chr(b).isalpha() else 32 for b in range(256))


def plain(text: str) -> bytes:
    """Lower-case letters, with their marks, of the whole text, words parted by one space, as UTF-8."""
    if text.isascii():
        return b" ".join(text.lower().encode().translate(_ASCII).split())
    return _OTHER.sub(" ", text.lower()).strip().encode()


_SAMPLE = "lang string, rank long, text string, n long"


def _sampler(dict_bytes: int):
    """Per task, keep for each language the first distinct texts in hash order that fill a dictionary; one row of it carries the sum of ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list] = {}
        held: Counter[str] = Counter()
        seen: set[tuple[str, int, str]] = set()
        total: Counter[str] = Counter()
        for batch in batches:
            texts = batch.column(2)
            for i, (lang, rank, n) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)))):
                total[lang] += n
                heap = kept.setdefault(lang, [])
                if held[lang] >= dict_bytes and rank > -heap[0][0]:
                    continue  # behind a full dictionary
                text = texts[i].as_py()
                if (lang, rank, text) in seen:
                    continue
                seen.add((lang, rank, text))
                heapq.heappush(heap, (-rank, text))
                held[lang] += len(text.encode())
                while held[lang] - len(heap[0][1].encode()) >= dict_bytes:
                    back, gone = heapq.heappop(heap)
                    seen.discard((lang, -back, gone))
                    held[lang] -= len(gone.encode())
        rows = [(lang, -rank, text, 0 if i else total[lang]) for lang, heap in kept.items() for i, (rank, text) in enumerate(heap)]
        if rows:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=["lang", "rank", "text", "n"])

    return run


def train(labelled: DataFrame, dict_bytes: int = DICT_BYTES, text: str = "text", lang: str = "lang", seed: int = 17, max_labels: int = MAX_LABELS) -> dict[str, bytes]:
    """{language: dictionary content}, most frequent first, from a bounded sample of the labelled rows."""
    labels = labelled.agg(F.count_distinct(col(lang).cast("string")).alias("n")).first().n
    if labels > max_labels:
        raise ValueError(f"{labels} distinct labels in column {lang}, at most {max_labels} are taken as languages")
    own, most = col(text), dict_bytes // 8
    rank = F.xxhash64(F.lit(seed), own)
    # a piece of a long text, cut by characters; at four bytes each it stays below `most` bytes
    place = F.pmod(rank, F.greatest(F.char_length(own) - most // 4, F.lit(0)) + 1).cast("int") + 1
    piece = F.when(F.octet_length(own) <= most, own).otherwise(F.substring(own, place, F.lit(most // 4)))
    rows = labelled.select(col(lang).cast("string").alias("lang"), rank.alias("rank"), piece.alias("text"), F.lit(1).cast("long").alias("n"))
    rows = rows.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    few = rows.mapInArrow(lean(_sampler(dict_bytes)), _SAMPLE)
    # the samples of very many tasks are merged by several tasks for each language, then by one
    for by in (["lang", F.pmod("rank", F.lit(64))], ["lang"]):
        few = few.repartition(*by).mapInArrow(lean(_sampler(dict_bytes)), _SAMPLE)
    found: dict[str, list] = {}
    total: Counter[str] = Counter()
    for row in few.collect():  # at most dict_bytes and one text more for each language
        found.setdefault(row.lang, []).append((row.rank, row.text))
        total[row.lang] += row.n
    order = sorted(total, key=lambda k: (-total[k], k))
    return {k: b"\n".join(plain(t) for _, t in sorted(found[k], reverse=True))[-dict_bytes:] for k in order}


def _classifier(model: dict[str, bytes], level: int, passed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = list(model)
        coders = []
        for lang in langs:
            content = zstandard.ZstdCompressionDict(model[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            coders.append(zstandard.ZstdCompressor(dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False))
        for batch in batches:
            guess, margin = [], np.zeros(batch.num_rows)
            for i, value in enumerate(batch.column(batch.num_columns - 1)):
                text = value.as_py()
                if not coders or not text or not _LETTER.search(text):
                    guess.append(UNKNOWN)
                    continue
                data = plain(text)
                sizes = [sum(len(c.compress(data[k : k + PIECE])) for k in range(0, len(data), PIECE)) for c in coders]
                order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
                guess.append(langs[order[0]])
                margin[i] = 1.0 if len(sizes) == 1 else 1.0 - sizes[order[0]] / sizes[order[1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:passed], pa.array(guess, pa.string()), pa.array(margin)], names=[*batch.schema.names[:passed], "__lang_pred", "__score"])

    return run


def identify(docs: DataFrame, model: dict[str, bytes], text: str = "text", level: int = 6, min_margin: float = 0.0, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all but the text) plus ``lang_pred``, ``score`` and ``rejected``.
    The text itself may be among ``keep``.

    ``score`` is 1 - best size / second-best size; ``rejected`` holds for ``und`` and for scores
    below ``min_margin``.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    names = ["__text" if c == text else f"__k{i}" for i, c in enumerate(keep)]
    plain = docs.select(*[col(c).alias(n) for c, n in zip(keep, names) if c != text], col(text).alias("__text"))
    passed = plain.schema.fields if text in keep else plain.schema.fields[:-1]
    schema = T.StructType([*passed, T.StructField("__lang_pred", T.StringType()), T.StructField("__score", T.DoubleType())])
    out = plain.mapInArrow(lean(_classifier(model, level, len(passed))), schema)
    rejected: Column = (F.col("__lang_pred") == UNKNOWN) | (F.col("__score") < min_margin)
    kept = apart(keep, ["lang_pred", "score", "rejected"])
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names)], F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"), rejected.alias("rejected"))
