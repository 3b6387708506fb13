"""Deterministic random draws from md5.

A draw depends only on its salt and the row's own key, never on partitioning
or on the rows before it, so a retried or re-partitioned task draws the same.
One md5 gives 32 hex digits; several small draws are cut from one digest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(salt: str, *keys: Column, blocks: int = 1) -> Column:
    """``blocks`` md5 digests of ``salt|key...|block`` joined, 32 hex digits each."""
    text = [key.cast("string") for key in keys]
    parts = [F.md5(F.concat_ws("|", F.lit(salt), *text, F.lit(str(b)))) for b in range(blocks)]
    return parts[0] if blocks == 1 else F.concat(*parts)


def draw(hex_text: Column, start: int | Column, width: int, bound: int | Column) -> Column:
    """A whole number in ``[0, bound)`` from ``width`` hex digits at ``start`` (1-based).

    Of digits held as binary any piece is cut at once; in a string Spark counts its way there.
    """
    begin = F.lit(start) if isinstance(start, int) else start
    digits = F.substring(hex_text, begin, F.lit(width)).cast("string")
    value = F.conv(digits, 16, 10).cast("bigint")
    return value % (F.lit(bound) if isinstance(bound, int) else bound)


def cut(hex_text: Column, width: int, pieces: int | None = None) -> Column:
    """The digits in pieces of ``width``, for lambdas to draw from; all of them or the first few.

    A lambda that refers to a digest column may have its md5 inlined and run per
    element; the elements of an array are computed once.  A known number of pieces
    needs no pattern.
    """
    if pieces is None:
        return F.regexp_extract_all(hex_text, F.lit(f".{{{width}}}"), F.lit(0))
    return F.array(*[F.substring(hex_text, 1 + width * i, width) for i in range(pieces)])


def shuffled(hex_text: Column, size: int, first: int | None = None) -> Column:
    """The numbers ``0..size-1`` ordered by six hex digits each; all of them or the first few."""
    keyed = F.array(
        *[
            F.concat(F.substring(hex_text, 1 + 6 * i, 6), F.lit(f"{i:02d}"))
            for i in range(size)
        ]
    )
    # sorted before anything is computed per element, and by the type's own order: no lambda
    order = F.sort_array(keyed)
    kept = order if first is None else F.slice(order, 1, first)
    return F.transform(kept, lambda entry: F.substring(entry, F.lit(7), F.lit(2)).cast("int"))
