"""Token counts by heap-and-linked-list byte-pair merging, without token ids.

A word's symbols form a linked list, its adjacent pairs a heap by merge rank; the lowest rank (the
leftmost of equals) is popped and merged until no pair has a rank. The word's count is its initial
symbols minus the merges made. Words repeat, so a worker remembers the counts of those it has met.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How byte-level vocabularies cut a text into words (fixed value, a public pattern).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose counts a Python worker remembers; at the limit it starts anew.
REMEMBERED = 600_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Initial symbols minus merges."""
    n = len(symbols)
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    symbols = list(symbols)
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := ranks.get((a, b))) is not None]
    heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heappop(heap)
        j = after[i]
        if j < 0 or symbols[i] != a or symbols[j] != b:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = a + b, ""
        merges += 1
        k = after[i] = after[j]
        after[j] = -1
        if k >= 0:
            before[k] = i
            if (r := ranks.get((a + b, symbols[k]))) is not None:
                heappush(heap, (r, i, a + b, symbols[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], a + b))) is not None:
            heappush(heap, (r, h, symbols[h], a + b))
    return n - merges


class Counter:
    """Counts the tokens of texts under one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {(a, b): k for k, (a, b) in enumerate(merges)}
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.words = regex.compile(WORDS)
        self.odd = regex.compile(r"[^\S \n]|  | \n|\n |\n\n|^[ \n]|[ \n]$")  # not single blanks and line ends between words
        self.symbol = byte_symbols()
        self.by_word: dict[str, int] = {}
        self.by_chunk: dict[str, int] = {}

    def word(self, word: str) -> int:
        found = self.by_word.get(word)
        if found is None:
            found = self.by_word[word] = merged_count([self.symbol[b] for b in word.encode()], self.ranks)
        return found

    def plain(self, text: str) -> int:
        return sum(map(self.word, self.words.findall(text)))

    def chunk(self, chunk: str) -> int:
        """A chunk between blanks: the blank belongs to it, unless it begins with a line end."""
        found = self.by_chunk[chunk] = self.plain(chunk if chunk[0] == "\n" else " " + chunk)
        return found

    def count(self, text: str) -> int:
        for known in (self.by_word, self.by_chunk):
            if len(known) > REMEMBERED:
                known.clear()
        total = 0
        parts = self.cut.split(text)
        for part in parts:
            if not part:
                continue
            if self.odd.search(part):
                total += self.plain(part)
                continue
            first, *chunks = part.replace("\n", " \n").split(" ")
            total += self.plain(first)
            known = self.by_chunk
            try:
                total += sum(map(known.__getitem__, chunks))
            except KeyError:
                total += sum(known[c] if c in known else self.chunk(c) for c in chunks)
        return total + len(parts) - 1  # each special string is one token


@cache
def counter_of(path: str) -> Counter:
    """One for each Python worker, so that its later tasks know the words of the earlier ones."""
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str, *, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every whole text.

    A null text counts as empty (0, 0, false). One row per input row, repeated ids included; other
    columns are not read. A word of any length is merged in n log n.
    """
    docs = docs.select("doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array([counter.count(t) for t in texts], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
