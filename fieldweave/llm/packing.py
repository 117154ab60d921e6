"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces whose lengths are the powers of two that sum to n, none above
the limit; pieces of equal length form a bucket, and each piece is a sequence of its own. So no
sequence crosses documents and none is padded.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import pairwise
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldweave.llm.lean import lean

#: Words whose ids a Python worker remembers; beyond, those that have not come up again are forgotten.
REMEMBERED = 1_000_000
#: A word of letters (composed and small ones too, up to the Arabic blocks) and the marks behind it, which the tokenizer cuts apart.
LETTERS = "^(?P<base>[{}]+)(?P<marks>[!-/:-@\\[-`{{-~]*)$".format("".join(c for c in map(chr, range(0x900)) if normalize("NFC", c).lower().isalpha()))


def piece_lengths(n: int, limit: int) -> list[int]:
    """Powers of two that sum to n, largest first, each at most ``limit`` (itself a power of two)."""
    return pieces_of(np.array([n]), limit)[1].tolist()


def pieces_of(totals: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of rows of so many ids, in order: whose each is, and its length."""
    powers = limit >> np.arange(limit.bit_length())
    times = np.column_stack([totals // limit, (totals[:, None] & powers[1:]) > 0]).ravel()
    at = np.repeat(np.arange(len(times)), times)
    return at // len(powers), powers[at % len(powers)]


def _bounds(lengths: np.ndarray) -> np.ndarray:
    return np.append(np.array(0, dtype="<i4"), np.cumsum(lengths, dtype="<i4"))


class WordIds:
    """Ids of texts by the tokenizer, which never joins across a blank or line end.

    Words repeat: those of all texts of a batch are told apart first, and the ids (little-endian,
    4 bytes each) of what they are made of are remembered, letters apart from the marks behind them.
    New words of letters are encoded many at a time: each ends with the one id that closes a word.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        self.tokenizer = Tokenizer.from_file(path)
        self.latin = Tokenizer(self.tokenizer.model)  # words that need neither composition nor cutting
        self.latin.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        closing = [i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]
        self.closes = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        self.closes[closing] = True
        self.remembered = remembered
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _learn(self, words: Iterable[str]) -> None:
        known, older = self.known, self.older
        latin, letters, odd = [], [], []
        for word in words:
            if (found := older.get(word)) is not None:
                known[word] = found
            elif not word.isalpha():
                odd.append(word)
            elif word.isascii() or max(word) < "\u0280" and "\u0130" not in word:  # whose small letters are two characters
                latin.append(word)
            else:
                letters.append(word)
        for tokenizer, group, small in ((self.latin, latin, str.lower), (self.tokenizer, letters, str)):
            for at in range(0, len(group), 5000):
                some = group[at : at + 5000]
                if not self._keep(some, tokenizer.encode_batch_fast([small(" ".join(some))], add_special_tokens=False)[0].ids):
                    odd += some  # a word that the tokenizer cuts in another way
        for word, found in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            known[word] = np.array(found.ids, dtype="<u4").tobytes()

    def _keep(self, words: list[str], found: list[int]) -> bool:
        """Remember the ids of the words, unless they are not one closing id a word."""
        ids = np.array(found, dtype="<u4")
        bounds = [0, *(4 * np.flatnonzero(self.closes[ids]) + 4).tolist()]
        if len(bounds) != len(words) + 1:
            return False
        raw = ids.tobytes()
        self.known.update((w, raw[i:j]) for w, i, j in zip(words, bounds, bounds[1:], strict=False))
        return True

    def together(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin and end."""
        if len(self.known) > self.remembered:
            self.known, self.older = {"": b""}, self.known
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = split.values.dictionary_encode()
        cut = pc.extract_regex(words.dictionary, LETTERS)
        base, marks = (pc.struct_field(cut, k) for k in ("base", "marks"))
        base = pc.if_else(cut.is_valid(), pc.ascii_lower(base), words.dictionary)
        marks = pc.if_else(cut.is_valid(), marks, "")
        parts = pa.concat_arrays([base, marks]).dictionary_encode()
        names = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        own = list(map(self.known.get, names))
        new = [at for at, found in enumerate(own) if found is None]
        self._learn(names[at] for at in new)
        for at in new:
            own[at] = self.known[names[at]]
        lengths = np.fromiter(map(len, own), dtype="<i4", count=len(own)) // 4
        ids = pa.ListArray.from_arrays(_bounds(lengths), np.frombuffer(b"".join(own), dtype="<u4"))
        of_word = ids.take(pa.array(parts.indices.to_numpy().reshape(2, -1).T.ravel()))  # each word's base, then its marks
        ids = pa.ListArray.from_arrays(of_word.offsets[::2], of_word.values).take(words.indices)
        return ids.values.to_numpy(), ids.offsets.to_numpy()[split.offsets.to_numpy()]

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        ids, bounds = self.together(pa.array(texts, pa.string()))
        for start, end in pairwise(bounds.tolist()):
            yield ids[start:end]


@cache
def word_ids(path: str, remembered: int) -> WordIds:
    """One for each Python worker, so that its later tasks know the words of the earlier ones."""
    return WordIds(path, remembered)


PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def pack(docs: DataFrame, tokenizer: str, *, limit: int = 2048, end_id: int = 1, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, bucket, sequence_id, offset.

    ``remembered`` bounds the words that a Python worker keeps (200 bytes each, twice as many at
    most). ``with_ids`` adds the ids (array of int). A null or empty text is its end id alone. Repeated rows
    are packed each. Very long texts give more pieces, nothing else. No rows: no pieces. Only doc_id
    and text are read. There is no shuffle: a piece needs no other, and bucket = log2(length) is the
    column to partition a written table by.
    """
    docs = docs.select("doc_id", "text")
    schema = T._parse_datatype_string(PIECES + (", ids array<int>" if with_ids else ""))
    schema = T.StructType([docs.schema["doc_id"], *schema.fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(tokenizer, remembered)
        for batch in batches:
            ids, bounds = known.together(pc.fill_null(batch.column(1), ""))
            ids = np.insert(ids, bounds[1:], end_id)
            first = bounds[:-1] + np.arange(len(batch))
            total = np.diff(bounds) + 1
            where, lengths = pieces_of(total, limit)
            ends = np.cumsum(lengths)  # the pieces of all rows follow each other as the ids do
            raw = memoryview(ids.tobytes())
            sums = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in pairwise([0, *ends.tolist()])]
            columns = [ends - lengths - first[where], lengths, sums, total[where]]
            arrays = [batch.column(0).take(pa.array(where)), *(pa.array(c, pa.int64()) for c in columns)]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(_bounds(lengths), ids.view("<i4")))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    pieces = docs.mapInArrow(lean(cut), schema)
    return pieces.select(
        "*",
        F.round(F.log2("length")).cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
