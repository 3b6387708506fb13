"""Scalar text functions as native Column expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmill.functions.binding import let

# Every character Python's str.strip() removes; built from the rule itself.
BLANKS = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())

# Decimal digits of all scripts and the ASCII digit each one stands for.
_SCRIPT_DIGITS = [
    chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"
]
_ASCII_DIGITS = "".join(str(unicodedata.decimal(d)) for d in _SCRIPT_DIGITS)

# Already canonical numbers, and ASCII texts without a digit: most leaves are one or the other.
_CANONICAL = r"^(0|[1-9][0-9]{0,10})(\.[0-9]{0,3}[1-9])?$"
_PLAIN_TEXT = r"^[\x00-\x2F\x3A-\x7F]*$"
_NUMBER = r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"
# Short enough that the decimal text itself equals the rounded double.
_SHORT_NUMBER = r"^-?[0-9]{0,11}(\.[0-9]{0,4})?$"


def strip_blanks(col: Column) -> Column:
    """Trim every Unicode blank on both sides (``trim`` alone knows only the space)."""
    return F.btrim(col, F.lit(BLANKS))


def strip_thousands(col: Column) -> Column:
    """``" 1,200 "`` -> ``"1200"``."""
    return strip_blanks(F.replace(col, F.lit(","), F.lit("")))


def top_key(path: Column) -> Column:
    """``menu[].name`` -> ``menu``: everything before the first ``.`` or ``[``."""
    return F.substring_index(F.substring_index(path, ".", 1), "[", 1)


def json_string(text: Column) -> Column:
    """A text as JSON string; only one with a quote, backslash or control sign needs a writer."""
    listed = F.to_json(F.array(text))
    return F.when(
        text.rlike(r'["\\\x00-\x1F]'), F.substring(listed, F.lit(2), F.length(listed) - 2)
    ).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def json_block(raw: Column) -> Column:
    """First ``{`` to last ``}``, greedy; NULL if there is none."""
    return F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))


def _drop_trailing_zeros(number: Column) -> Column:
    return F.when(
        F.contains(number, F.lit(".")), F.rtrim(F.rtrim(number, F.lit("0")), F.lit("."))
    ).otherwise(number)


def fixed4(value: Column) -> Column:
    """A double with four decimals, rounded from its exact binary value.

    ``format_string('%.4f')`` and ``round`` start from the shortest decimal text
    of the double, so ties such as 0.03125 or 0.00015 go the other way there.
    Here the double is split into whole numbers that decimal arithmetic holds
    exactly: integer part in two 53-bit halves, fraction in units of 2**-68.
    Exact below 2**116; beyond that the plain format is used.
    """

    def units(part: Column) -> Column:
        return part.try_cast("bigint").cast("decimal(20,0)")

    def split(v: Column) -> Column:
        frac = v % F.lit(1.0)
        whole = v - frac
        low = whole % F.lit(2.0**53)
        scaled = frac * F.lit(2.0**34)
        coarse = scaled - scaled % F.lit(1.0)
        rest = (scaled % F.lit(1.0)) * F.lit(2.0**34)
        fine = rest - rest % F.lit(1.0)
        return F.struct(
            (
                units((whole - low) / F.lit(2.0**53)) * F.lit(2**53).cast("decimal(17,0)")
                + units(low)
            ).alias("whole"),
            (
                (units(coarse) * F.lit(2**34).cast("decimal(11,0)") + units(fine)).cast(
                    "decimal(22,0)"
                )
                * F.lit(10000).cast("decimal(5,0)")
            )
            .cast("decimal(27,0)")
            .alias("scaled"),
            (rest % F.lit(1.0) > 0).alias("more"),
        )

    unit = F.lit(str(2**68)).cast("decimal(21,0)")

    def divide(s: Column) -> Column:
        quotient = F.floor(s["scaled"] / unit).cast("bigint")
        return F.struct(
            s["whole"].alias("whole"),
            quotient.alias("digits"),
            ((s["scaled"] - quotient.cast("decimal(6,0)") * unit) * F.lit(2)).alias("twice"),
            s["more"].alias("more"),
        )

    def render(s: Column) -> Column:
        up = (s["twice"] > unit) | (
            (s["twice"] == unit) & (s["more"] | (s["digits"] % 2 == 1))
        )
        digits = s["digits"] + F.when(up, 1).otherwise(0)
        whole = s["whole"].cast("decimal(38,0)") + F.when(digits == 10000, 1).otherwise(0)
        return F.concat(
            whole.cast("decimal(38,0)").cast("string"),
            F.lit("."),
            F.lpad((digits % 10000).cast("string"), 4, "0"),
        )

    # Each step runs as a one-element transform, so its input is computed once.
    steps = F.transform(F.transform(F.transform(F.array(F.abs(value)), split), divide), render)
    near = F.floor(F.abs(value) * F.lit(10000.0) + F.lit(0.5))
    plain = F.concat(
        F.floor(near / 10000).cast("string"),
        F.lit("."),
        F.lpad((near % 10000).cast("string"), 4, "0"),
    )
    negative = (value < 0) | ((value == 0) & F.startswith(value.cast("string"), F.lit("-")))
    return (
        F.when(
            F.abs(value) < F.lit(2.0**116),
            F.concat(
                F.when(negative, "-").otherwise(""),
                F.when(_far_from_tie(F.abs(value)), plain).otherwise(F.element_at(steps, 1)),
            ),
        )
        .otherwise(F.format_string("%.4f", value))
    )


def _far_from_tie(value: Column) -> Column:
    """Whether the scaled value's own error (below 1e-6) cannot change the rounding."""
    scaled = value * F.lit(10000.0)
    return (value < 1e5) & (F.abs(scaled % F.lit(1.0) - F.lit(0.5)) > 1e-6)


def round4(value: Column) -> Column:
    """A double rounded to four decimals from its exact binary value."""
    plain = F.floor(value * F.lit(10000.0) + F.lit(0.5)) / F.lit(10000.0)
    return F.when((value >= 0) & _far_from_tie(value), plain).otherwise(
        fixed4(value).cast("double")
    )


def normalize_value(col: Column) -> Column:
    """Canonical text of a leaf: number form if its digits form one, else lower case.

    Currency signs, thousands separators and words around a number vanish:
    ``"$1,200.00"`` -> ``"1200"``, ``"2 cokes"`` -> ``"2"``, ``" Coke "`` -> ``"coke"``.
    """

    def clean(text: Column) -> Column:
        ascii_digits = F.when(
            text.rlike(r"[^\x00-\x7F]"),
            F.translate(text, "".join(_SCRIPT_DIGITS), _ASCII_DIGITS),
        ).otherwise(text)
        return F.regexp_replace(ascii_digits, r"[^0-9.\-]", "")

    def canonical(text: Column, cleaned: Column) -> Column:
        with_zero = F.regexp_replace(cleaned, r"^(-?)\.", "$10.")
        short = _drop_trailing_zeros(F.regexp_replace(with_zero, r"^(-?)0+(?=[0-9])", "$1"))
        number = F.when(cleaned.rlike(_SHORT_NUMBER), short).otherwise(
            _drop_trailing_zeros(fixed4(cleaned.try_cast("double")))
        )
        return F.when(cleaned.rlike(_NUMBER), number).otherwise(F.lower(text))

    def shortest(text: Column) -> Column:
        return (
            F.when(text.rlike(_CANONICAL), text)
            .when(text.rlike(_PLAIN_TEXT), F.lower(text))
            .otherwise(let(canonical, text=text, cleaned=clean(text)))
        )

    return let(shortest, text=strip_blanks(col))


def plan_downscale(width: Column, height: Column, cap: int | None) -> Column:
    """``struct<width,height>`` that fits ``cap`` pixels; unchanged if it already does."""
    if cap is None:
        return F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))
    area = width.cast("bigint") * height.cast("bigint")
    scale = F.sqrt(F.lit(float(cap)) / area)

    def shrink(side: Column) -> Column:
        return (
            F.when(area <= cap, side.cast("int"))
            .otherwise(F.greatest(F.lit(1), (side * scale).cast("int")))
        )

    return F.struct(shrink(width).alias("width"), shrink(height).alias("height"))
