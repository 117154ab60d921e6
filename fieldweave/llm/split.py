"""Who may be learnt from, by crc32 of the id as text; places of values between cuts; free column names."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True where crc32(doc_id as text) mod ``parts`` is ``part``; a null id reads as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def cuts_below(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are not above the value: first by groups, then in one group, so
    that thousands of cuts cost some dozens of comparisons a row."""
    if not cuts:
        return F.lit(0)
    size = math.isqrt(len(cuts) - 1) + 1
    groups = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    below = lambda xs: F.size(F.filter(xs, lambda c: c <= value))
    group = below(longs([g[0] for g in groups]))
    inside = below(F.element_at(F.array(*map(longs, groups)), F.greatest(group, F.lit(1))))
    return F.when(group == 0, F.lit(0)).otherwise((group - 1) * size + inside)


def free(name: str, columns: list[str]) -> str:
    """``name``, with underlines behind it until no column is called so (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
