"""Character vocabularies: built from training names, used to encode and decode."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The two entries that every vocabulary begins with, and their numbers (fixed values).
PAD, UNKNOWN = ("<PAD>", 0), ("<UNK>", 1)
#: No alphabet is larger, so a vocabulary may be held by every task.
MOST_CHARACTERS = 0x110000


def character_counts(names: DataFrame, column: str) -> DataFrame:
    """token, count of each character of the (normalized) names."""
    return names.select(F.explode(F.filter(F.split(column, ""), lambda x: x != "")).alias("token")).groupBy("token").agg(F.count("*").alias("count"))


def build_vocabulary(counts: DataFrame, min_frequency: int = 1) -> list[str]:
    """Tokens in the order of their numbers: the fixed two, then characters by code point."""
    if min_frequency < 1:
        raise ValueError("min_frequency must be positive")
    rows = counts.filter(F.col("count") >= min_frequency).select("token").limit(MOST_CHARACTERS).collect()
    return [PAD[0], UNKNOWN[0], *sorted(r["token"] for r in rows)]


def vocabulary_table(spark: SparkSession, tokens: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(tokens)), "id int, token string").select("token", "id")


def numbers(tokens: list[str]) -> Column:
    """The vocabulary as a map literal."""
    return F.create_map(*[x for k, t in enumerate(tokens) for x in (F.lit(t), F.lit(k))])


def encode(name: Column, tokens: list[str], max_length: int) -> Column:
    """The first ``max_length`` characters as numbers, unknown ones as 1, filled up with 0.

    The characters stay inside one expression: no join, no Python.
    """
    known = numbers(tokens)
    letters = F.filter(F.split(F.substring(name, 1, max_length), ""), lambda x: x != "")
    ids = F.transform(letters, lambda x: F.coalesce(F.try_element_at(known, x), F.lit(UNKNOWN[1])))
    return F.concat(ids, F.array_repeat(F.lit(PAD[1]), F.lit(max_length) - F.size(ids)))


def decode(ids: Column, tokens: list[str], skip_pad: bool = True) -> Column:
    """The text of the numbers; those outside the vocabulary read as unknown."""
    kept = F.filter(ids, lambda i: i != PAD[1]) if skip_pad else ids
    table = F.array(*[F.lit(t) for t in tokens])
    return F.array_join(F.transform(kept, lambda i: F.coalesce(F.when((i >= 0) & (i < len(tokens)), F.element_at(table, i + 1)), F.lit(UNKNOWN[0]))), "")


class CharVocabulary:
    """A vocabulary as an object: its tokens in the order of their numbers, and expressions for columns."""

    def __init__(self, tokens: Sequence[str]):
        tokens = tuple(tokens)
        if tokens[:2] != (PAD[0], UNKNOWN[0]):
            raise ValueError(f"a vocabulary begins with {PAD[0]} and {UNKNOWN[0]}")
        if len(set(tokens)) != len(tokens) or any(len(t) != 1 for t in tokens[2:]):
            raise ValueError("all other tokens must be single characters that differ")
        self.id_to_token = self.itos = tokens
        self.token_to_id = self.stoi = {t: k for k, t in enumerate(tokens)}

    @classmethod
    def build(cls, names: DataFrame, column: str, min_frequency: int = 1) -> CharVocabulary:
        return cls(build_vocabulary(character_counts(names, column), min_frequency))

    def __len__(self) -> int:
        return len(self.id_to_token)

    def encode(self, name: Column, max_length: int) -> Column:
        return encode(name, list(self.id_to_token), max_length)

    def decode(self, ids: Column, skip_pad: bool = True) -> Column:
        return decode(ids, list(self.id_to_token), skip_pad)

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps({"tokens": list(self.id_to_token)}, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")

    @classmethod
    def load(cls, path: str | Path) -> CharVocabulary:
        found = json.loads(Path(path).read_text(encoding="utf-8-sig"))
        if "tokens" not in found:
            raise ValueError(f"{path} has no tokens")
        return cls(found["tokens"])


#: Other names that callers know it by.
CharacterVocabulary = Vocabulary = CharVocabulary
