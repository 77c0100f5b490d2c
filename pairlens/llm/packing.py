"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Documents become token ids and an end id; only those longer than the capacity are cut. The plan is
made on the histogram of piece lengths, which has at most ``capacity`` rows whatever the input: for
each length, longest first, an index of single, pair and triple sums gives the lengths that exactly
fill the gap, taken as often as counts allow. What no exact combination fills goes to the fullest
sequence it fits (best-fit decreasing, on counts). The plan never takes more sequences than best-fit
decreasing alone.
Pieces of a length are numbered in Spark (by salted groups, so that one very common length is many
groups) and looked up in the plan's number ranges.

Defined results: a null or empty text is the end id alone; null ids are ordinary ids; rows that
repeat are packed one by one; an empty table gives no rows; a text of any length is tokenized whole.
Further columns pass through; one that bears the name of an added column gets ``_`` appended.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, col, cut, held, lean, sliced

CAPACITY = 4096


class WordEncoder:
    """Token ids by a tokenizer that never joins characters across white space.

    Ids are remembered by word (ASCII white space parts words, A-Z is lower-cased as the tokenizer
    does). ASCII punctuation at the end of a word is a token run of its own if a letter or digit
    stands before it, so words are learned without it. Unknown words of a slice are tokenized
    together, parted by a character that is a token of its own between blanks; words that hold that
    character, and texts that hold the opening characters of a special token, are tokenized alone.
    Words of ASCII letters go to the tokenizer's model directly where its other steps leave them as
    they are.
    """

    MEMO = 600_000  # words remembered at a time
    PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # not the apostrophe, which can begin a token run
    PARTING = "\u20ac"

    def __init__(self, path: str, special: str = "<|"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark, self.parting = special.encode(), self.PARTING.encode()
        self.parting_ids = self.tokenizer.encode(self.PARTING, add_special_tokens=False).ids
        self.memo: dict[bytes, bytes] = {}
        self.letters: dict[str, bool] = {}
        self.model = self.tokenizer.model
        probes = ("a", "probe", "abcdefghijklmnopqrstuvwxyz", "zq" * 20)
        self.direct = all([t.id for t in self.model.tokenize(p)] == self.tokenizer.encode(p, add_special_tokens=False).ids for p in probes)
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _tail(self, word: bytes) -> bytes:
        """Punctuation at the end of the word that is a token run of its own."""
        stem = word.rstrip(self.PUNCTUATION)
        if len(stem) == len(word) or not stem:
            return b""
        alone = stem[-1:].isalnum() if stem[-1] < 128 else self._ends_alone(stem[-4:].decode(errors="ignore")[-1:])
        return word[len(stem) :] if alone else b""

    def _ends_alone(self, letter: str) -> bool:
        """Whether the letter still ends in a letter once it is normalised: a mark would run together with punctuation."""
        if letter not in self.letters:
            self.letters[letter] = self.tokenizer.normalizer.normalize_str(letter)[-1:].isalpha()
        return self.letters[letter]

    def _learn(self, words: set[bytes]) -> None:
        if len(self.parting_ids) > 1:  # the character is no single token here
            for word in words:
                self.memo[word] = self._whole(word.decode())
            return
        tails = {w: t for w in words if (t := self._tail(w))}
        parts = (words - tails.keys()) | {w[: -len(t)] for w, t in tails.items()} | set(tails.values())
        plain = []
        for word in parts - self.memo.keys():
            if self.direct and word.isalpha():
                self.memo[word] = b"".join([self.id_bytes[t.id] for t in self.model.tokenize(word.decode())])
            elif self.parting in word:
                self.memo[word] = self._whole(word.decode())
            else:
                plain.append(word)
        groups = [plain[k : k + 200] for k in range(0, len(plain), 200)]
        found = self.tokenizer.encode_batch_fast([f" {self.PARTING} ".join(w.decode() for w in some) for some in groups], add_special_tokens=False)
        for some, encoding in zip(groups, found):
            ids = np.array(encoding.ids, "<u4")
            ends = np.flatnonzero(ids == self.parting_ids[0]) * 4
            data, begin = ids.tobytes(), 0
            for word, end in zip(some, [*ends.tolist(), len(data)]):
                self.memo[word] = data[begin:end]
                begin = end + 4
        for word, tail in tails.items():
            self.memo[word] = self.memo[word[: -len(tail)]] + self.memo[tail]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.memo) > self.MEMO:
            self.memo.clear()
        found: list = []
        missing: set[bytes] = set()
        for text in texts:
            data = (text or "").encode()
            if self.mark in data:
                found.append(self._whole(text))
                continue
            words = data.lower().split()
            ids = list(map(self.memo.get, words))
            if None in ids:
                missing.update(w for w, v in zip(words, ids) if v is None)
                found.append(words)
            else:
                found.append(b"".join(ids))
        self._learn(missing)
        return [x if isinstance(x, bytes) else b"".join(map(self.memo.__getitem__, x)) for x in found]


class TextEncoder:
    """Token ids by any tokenizer file, each text as a whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


#: The steps of a tokenizer file whose tokens never reach across ASCII white space.
WORD_STEPS = {
    "normalizer": [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)],
    "pre_tokenizer": [("Split", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), ("ByteLevel", None)],
}


def parts_at_blanks(path: str) -> bool:
    """Whether ``WordEncoder`` gives this file's ids: its steps are the known ones and special tokens begin with ``<|``."""
    with open(path, encoding="utf-8") as f:
        stored = json.load(f)
    steps = lambda s: [(x["type"], x.get("pattern", {}).get("Regex")) for x in (s or {}).get("normalizers", (s or {}).get("pretokenizers", []))]
    special = all(t["content"].startswith("<|") for t in stored.get("added_tokens", []))
    return special and stored["model"]["type"] == "BPE" and not stored["model"].get("dropout") and all(steps(stored.get(k)) == v for k, v in WORD_STEPS.items())


_TOKENIZING = "tokenizing"


def _encoder(path: str):
    """Kept with its words for the worker's next task of this kind: some 200 MB once ``MEMO`` words are remembered."""
    return held(_TOKENIZING, path, lambda p: WordEncoder(p) if parts_at_blanks(p) else TextEncoder(p))


def tokenized(docs: DataFrame, tokenizer: str, text: str = "text", end_id: int = 1, capacity: int = CAPACITY, keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece: ``keep`` columns, piece, start, length, ids_crc32 and, if asked, ids (binary)."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    inner = [f"__k{i}" for i in range(len(keep))]
    plain = docs.select(*[col(c).alias(n) for c, n in zip(keep, inner)], col(text).alias("__text"))
    added = T._parse_datatype_string("piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))
    schema = T.StructType([*plain.schema.fields[:-1], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in sliced(batch, "__text"):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, data in enumerate(encoder.encode(part.column(part.num_columns - 1).to_pylist())):
                    data += end
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[at : at + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(own)
                chosen = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [c.take(chosen) for c in part.columns[:-1]]
                    + [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                    + ([pa.array(ids, pa.binary())] if with_ids else []),
                    names=schema.names,
                )

    out = plain.mapInArrow(lean(run, _TOKENIZING), schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(inner, apart(keep, [*added.names, "sequence_id", "offset"]))], *added.names)


class _Filling:
    """One way to fill sequences, with an index of the combinations that are left, by their sum.

    ``left[s]`` is how many pieces of length s are left, ``pairs[s]`` how many pairs of available
    lengths sum to s, ``triples[s]`` whether three did when the index was last renewed: availability
    only falls, so a sum without triples stays without.
    """

    RENEW = 256  # lengths used up between two renewals of the triples

    def __init__(self, counts: dict[int, int], capacity: int, floor: int):
        self.capacity, self.used_up = capacity, 0
        self.left = np.zeros(capacity + 1, np.int64)
        self.have = np.zeros(capacity + 1, bool)
        self.pairs = np.zeros(capacity + 1, np.int64)
        self.patterns: list[tuple[list[int], int]] = []
        for length, n in counts.items():
            self._add(length, n)
        self._renew()
        self._exact(floor)
        self._best_fit()

    def _renew(self) -> None:
        self.triples = np.convolve(self.have.astype(np.float64), (self.pairs > 0).astype(np.float64))[: self.capacity + 1] > 0.5

    def _add(self, length: int, n: int) -> None:
        """Change what is left of a length, and the pairs it makes."""
        before, after = int(self.left[length]), int(self.left[length]) + n
        self.left[length] = after
        if (before > 0) != (after > 0):
            self.have[length] = False
            self.pairs[length:] += (1 if after else -1) * self.have[: self.capacity + 1 - length]
            self.have[length] = after > 0
            self.used_up += not after
        if (before > 1) != (after > 1) and 2 * length <= self.capacity:
            self.pairs[2 * length] += 1 if after > 1 else -1

    def _times(self, lengths: list[int]) -> int:
        """How many sequences of these lengths the counts allow."""
        return min(int(self.left[x]) // lengths.count(x) for x in lengths)

    def _pair(self, total: int) -> list[int]:
        """The most available a <= b of a sum that has pairs."""
        half = total // 2
        both = np.minimum(self.left[1 : half + 1], self.left[total - 1 : total - half - 1 : -1])
        if 2 * half == total:
            both[-1] = self.left[half] // 2
        k = int(both.argmax())
        return [k + 1, total - k - 1]

    def _complement(self, gap: int) -> list[int] | None:
        """One, two or three available lengths that sum to ``gap``."""
        if self.have[gap]:
            return [gap]
        if self.pairs[gap]:
            return self._pair(gap)
        if not self.triples[gap]:
            return None
        for a in np.flatnonzero(self.have[: gap + 1] & (self.pairs[gap::-1] > 0))[::-1].tolist():  # largest first
            self._add(a, -1)
            found = [a, *self._pair(gap - a)] if self.pairs[gap - a] else None
            self._add(a, 1)
            if found:
                return found
        return None

    def _exact(self, floor: int) -> None:
        c = self.capacity
        if self.left[c]:
            self.patterns.append(([c], int(self.left[c])))
            self._add(c, -int(self.left[c]))
        for length in np.flatnonzero(self.have)[::-1].tolist():
            if length <= floor:
                break
            while self.left[length]:
                self._add(length, -1)
                others = self._complement(c - length)
                self._add(length, 1)
                if not others:
                    break
                lengths = [length, *others]
                times = self._times(lengths)
                for x in lengths:
                    self._add(x, -times)
                self.patterns.append((lengths, times))
                if self.used_up >= self.RENEW:
                    self.used_up = 0
                    self._renew()

    def _best_fit(self) -> None:
        """What is left, longest first, each into the smallest gap that holds it, many alike at a time."""
        open_: dict[int, list[tuple[list[int], int]]] = {}  # by gap
        for length in np.flatnonzero(self.left)[::-1].tolist():
            n = int(self.left[length])
            for gap in sorted(g for g in open_ if g >= length):
                while n and open_[gap]:
                    lengths, times = open_[gap].pop()
                    each = min(gap // length, n)  # a sequence that takes one takes as many as it holds
                    used = min(times, n // each)
                    n -= used * each
                    if times > used:
                        open_[gap].append((lengths, times - used))
                    open_.setdefault(gap - each * length, []).append((lengths + [length] * each, used))
            each = self.capacity // length
            for times, copies in ((n // each, each), (1, n % each)):
                if times and copies:
                    open_.setdefault(self.capacity - copies * length, []).append(([length] * copies, times))
        self.patterns += [p for kept in open_.values() for p in kept]


class Plan:
    """Patterns of lengths and how many sequences follow each.

    Exact complements are taken for lengths above a floor, longest first, then best fit places the
    rest. Several floors are tried, up to best fit alone, and the plan of fewest sequences stands; so
    short pieces are not spent where longer ones need them. Trying ends at the lower bound.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        least = -(-sum(k * n for k, n in counts.items()) // capacity)
        self.patterns: list[tuple[list[int], int]] = []
        for floor in (0, capacity // 2, capacity):
            found = _Filling(counts, capacity, floor).patterns
            if not self.patterns or sum(t for _, t in found) < self.sequences:
                self.patterns = found
            if self.sequences == least:
                break

    def ranges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Arrays sorted by (length, first number): that key, the first number, first sequence, offset."""
        used = np.zeros(self.capacity + 1, np.int64)
        rows, sequence = [], 0
        for lengths, times in self.patterns:
            offset = 0
            for length in lengths:
                rows.append((length, used[length], sequence, offset))
                used[length] += times
                offset += length
            sequence += times
        rows.sort()
        length, first, base, offset = np.array(rows, np.int64).reshape(-1, 4).T
        return (length << 44) + first, first, base, offset

    @property
    def sequences(self) -> int:
        return sum(times for _, times in self.patterns)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (column ``length``); read twice, so give stored ones."""
    pieces = pieces.toDF(*apart(pieces.columns, ["sequence_id", "offset"]))
    spark = pieces.sparkSession
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    key, first, base, offset = Plan(counts, capacity).ranges()
    plan = spark.sparkContext.broadcast((key, first, base, offset))
    # the number of a piece among those of its length: by salted group, plus what earlier groups hold
    salts = max(16, sum(counts.values()) // 500_000)
    salted = pieces.select(F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(pieces.columns)]).alias("row"), F.col("length").alias("n"), F.floor(F.rand(5) * salts).cast("int").alias("salt"))
    salted = cut(salted.withColumn("order", F.monotonically_increasing_id()))
    sizes = salted.groupBy("n", "salt").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select(F.col("n").alias("bn"), F.col("salt").alias("bs"), (F.sum("size").over(Window.partitionBy("n").orderBy("salt")) - F.col("size")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("n", "salt").orderBy("order")) - 1)
    numbered = ranked.join(before, (F.col("n") == F.col("bn")) & (F.col("salt") == F.col("bs"))).select("row", "n", (F.col("rank") + F.col("before")).alias("number"))
    schema = T.StructType([numbered.schema["row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, base, offset = plan.value
        for batch in batches:
            length, number = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            at = np.searchsorted(key, (length << 44) + number, side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base[at] + number - first[at]), pa.array(offset[at])], names=schema.names)

    out = numbered.mapInArrow(lean(place), schema)
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(pieces.columns)], "sequence_id", "offset")
