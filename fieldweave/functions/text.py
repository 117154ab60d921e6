"""Names, labels and markers as Spark columns."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldweave.functions.similarity import ratios

#: The relationship labels, as reports list them, and their numbers in a model (fixed values).
LABELS = ("DIRECT", "DERIVATION", "NO_MATCH")
LABEL_NUMBERS = {"NO_MATCH": 0, "DIRECT": 1, "DERIVATION": 2}
POSITIVE = ("DIRECT", "DERIVATION")

#: White space as Python's str.strip sees it.
_BLANK = r"[\s\x1c-\x1f]"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(stripped(c), F.lit("")) == ""


def normalized(c: Column) -> Column:
    """The name's identity: words of a camel-case, dotted, dashed or spaced name joined by ``_``, in
    small letters. For text that is already in compatibility form (all ASCII is)."""
    # the patterns that make names equal (fixed values)
    split = F.regexp_replace(stripped(c), r"(?<=[A-Z])(?=[A-Z][a-z])", "_")
    split = F.regexp_replace(split, r"(?<=[a-z0-9])(?=[A-Z])", "_")
    joined = F.regexp_replace(F.lower(split), r"(?U)[-.\s\x1c-\x1f_]+", "_")
    return F.btrim(joined, F.lit("_"))


@F.pandas_udf(T.StringType())
def compatibility_form(s: pd.Series) -> pd.Series:
    """Unicode NFKC, for which the JVM side has no function."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def with_normalized(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with a normalized column for each {column: new name}; null gives null.

    Rows that are all ASCII stay on the JVM side; only the others pass through Python. No shuffle.
    """
    ascii_only = F.lit(True)
    for c in columns:
        ascii_only = ascii_only & F.coalesce(F.col(c).rlike(r"^[\x00-\x7F]*$"), F.lit(True))
    plain, other = df.filter(ascii_only), df.filter(~ascii_only)
    plain = plain.withColumns({new: normalized(F.col(c)) for c, new in columns.items()})
    other = other.withColumns({new: normalized(compatibility_form(c)) for c, new in columns.items()})
    return plain.unionByName(other)


def label(c: Column) -> Column:
    return F.upper(stripped(c))


def synthetic_marker(c: Column) -> Column:
    """True or false for the spellings a raw file may use, null for any other."""
    word = F.lower(stripped(c))
    return F.when(word.isin("true", "1", "yes"), True).when(word.isin("false", "0", "no"), False)


def strict_boolean(c: Column) -> Column:
    """True or false for exactly these words (any case, blanks around), null for any other."""
    word = F.lower(stripped(c))
    return F.when(word == "true", True).when(word == "false", False)


def _ratios(a: pd.Series, b: pd.Series, autojunk: bool) -> pd.Series:
    out = pd.Series(np.nan, index=a.index)
    known = a.notna() & b.notna()
    out[known] = ratios(a[known].tolist(), b[known].tolist(), autojunk)
    return out


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of a to b (the order matters), every character counted."""
    return _ratios(a, b, False)


@F.pandas_udf(T.DoubleType())
def sequence_ratio_junk(a: pd.Series, b: pd.Series) -> pd.Series:
    """As sequence_ratio, but characters popular in a b of 200 or more are left out."""
    return _ratios(a, b, True)


@F.pandas_udf(T.DoubleType())
def rounded(x: pd.Series) -> pd.Series:
    """To six places as Python rounds: the nearest decimal of the binary value."""
    return x.map(lambda v: None if pd.isna(v) else round(v, 6))


def is_subsequence(short: Column, long: Column) -> Column:
    """Whether the letters of ``short`` occur in ``long`` in their order."""
    # the place after each letter's first occurrence beyond the one before; 0 is failure
    def step(at: Column, letter: Column) -> Column:
        found = F.call_function("locate", letter, long, at)
        return F.when((at == 0) | (found == 0), F.lit(0)).otherwise(found + 1)

    return F.aggregate(F.filter(F.split(short, ""), lambda x: x != ""), F.lit(1), step) > 0


def possible_abbreviation(a: Column, b: Column) -> Column:
    """A hint that one normalized name abbreviates the other.

    Either word by word (as many words; each equal or a subsequence of two letters at least, and one
    truly shorter), or one word of the initials of several.
    """

    def one_way(short: Column, long: Column) -> Column:
        s, g = F.split(short, "_"), F.split(long, "_")
        pairs = F.arrays_zip(s.alias("s"), g.alias("g"))
        shorter = F.exists(pairs, lambda p: (F.length(p["s"]) > 1) & (F.length(p["s"]) < F.length(p["g"])) & is_subsequence(p["s"], p["g"]))
        fits = F.forall(pairs, lambda p: (p["s"] == p["g"]) | ((F.length(p["s"]) >= 2) & is_subsequence(p["s"], p["g"])))
        initials = F.array_join(F.transform(g, lambda w: F.substring(w, 1, 1)), "")
        return F.when(F.size(s) == F.size(g), shorter & fits).otherwise(F.lit(False)) | ((F.size(s) == 1) & (F.size(g) > 1) & (short == initials))

    return one_way(a, b) | one_way(b, a)


def register(spark: SparkSession) -> None:
    """Makes the functions that need Python callable from SQL."""
    spark.udf.register("compatibility_form", compatibility_form)
    spark.udf.register("sequence_ratio", sequence_ratio)
    spark.udf.register("sequence_ratio_junk", sequence_ratio_junk)
