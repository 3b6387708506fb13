"""Plausible wrong answers out of a right one, drawn per ``(seed, split, index)``."""

from __future__ import annotations

import sys
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmill.functions.binding import let
from fieldmill.functions.draws import digest, draw, shuffled
from fieldmill.functions.text import json_string

# Prose openings, key renames, modes in their own order.
PROSE_PREFIXES = (
    "Here is the extracted JSON:\n",
    "Sure! The receipt contains the following data: ",
    "```json\n",
)
KEY_RENAMES = {
    "total": "sum",
    "subtotal": "sub_total",
    "tax": "vat",
    "menu": "items",
    "items": "menu",
    "vendor": "store",
    "date": "day",
}
MODES = ("digits", "drop_key", "rename_key", "prose", "truncate")
KEPT_SHARE = 0.7


def _digit_class() -> str:
    """Pattern of every character that counts as a digit, as code point ranges."""
    points = [c for c in range(sys.maxunicode + 1) if chr(c).isdigit()]
    runs = [
        [c for _, c in run] for _, run in groupby(enumerate(points), key=lambda e: e[1] - e[0])
    ]
    others = "".join(f"\\x{{{r[0]:x}}}-\\x{{{r[-1]:x}}}" for r in runs if r[0] > 127)
    # ASCII is decided first: the long class is only tried on other characters.
    return f"(?:[0-9]|(?=[^\\x00-\\x7F])[{others}])"


DIGIT = _digit_class()


def key_digest(seed: int, *keys: Column) -> Column:
    """The draws of one row: 32 hex digits for the choices, 32 for the mode order."""
    return digest(f"perturb|{seed}", *keys, blocks=2)


def replace_at(items: Column, at: Column, item: Column) -> Column:
    """The array with another item at a 0-based place."""
    return F.concat(
        F.slice(items, F.lit(1), at), F.array(item), F.slice(items, at + 2, F.size(items))
    )


def remove_at(items: Column, at: Column) -> Column:
    return F.concat(F.slice(items, F.lit(1), at), F.slice(items, at + 2, F.size(items)))


def corrupt_digits(text: Column, hex_text: Column) -> Column:
    """Up to two different digits of the text change, each to another digit.

    In a mask of the text every digit is a 0: it tells how many there are and where each one
    stands, in code points.  The text is cut at two places only, so the work grows with its length.
    """

    def changed(digit: Column, h: Column, start: int) -> Column:
        value = F.coalesce(digit.try_cast("int"), F.lit(-1))
        fresh = draw(h, start, 4, F.when(value >= 0, F.lit(9)).otherwise(F.lit(10)))
        return F.when((value >= 0) & (fresh >= value), fresh + 1).otherwise(fresh).cast("string")

    def chosen(text: Column, h: Column, mask: Column, count: Column) -> Column:
        first = draw(h, 1, 6, F.greatest(count, F.lit(1))).cast("int")
        other = draw(h, 7, 6, F.greatest(count - 1, F.lit(1))).cast("int")
        return let(located, text=text, h=h, mask=mask, count=count, first=first, other=other)

    def located(
        text: Column, h: Column, mask: Column, count: Column, first: Column, other: Column
    ) -> Column:
        def place(nth: Column) -> Column:
            return F.length(F.call_function("substring_index", mask, F.lit("0"), nth + 1))

        second = other + F.when(other >= first, 1).otherwise(0)
        return let(spliced, text=text, h=h, count=count, at=place(first), too=place(second))

    def spliced(text: Column, h: Column, count: Column, at: Column, too: Column) -> Column:
        def digit(place: Column, start: int) -> Column:
            return changed(F.substring(text, place + 1, F.lit(1)), h, start)

        def pair(early: Column, one: Column, late: Column, two: Column) -> Column:
            between = F.substring(text, early + 2, late - early - 1)
            return F.concat(F.substring(text, F.lit(1), early), one, between, two, rest(late))

        def rest(place: Column) -> Column:
            return F.substring(text, place + 2, F.length(text))

        one, two = digit(at, 13), digit(too, 17)
        return (
            F.when(count == 0, text)
            .when(count == 1, F.concat(F.substring(text, F.lit(1), at), one, rest(at)))
            .when(at < too, pair(at, one, too, two))
            .otherwise(pair(too, two, at, one))
        )

    def masked(text: Column, h: Column, mask: Column) -> Column:
        count = F.length(mask) - F.length(F.replace(mask, F.lit("0"), F.lit("")))
        return let(chosen, text=text, h=h, mask=mask, count=count)

    ascii_only = F.octet_length(text) == F.length(text)
    mask = F.when(ascii_only, F.regexp_replace(text, "[1-9]", "0")).otherwise(
        F.regexp_replace(text, DIGIT, "0")
    )
    return let(masked, text=text, h=hex_text, mask=mask)


def join_members(members: Column) -> Column:
    """``array<struct<key,value>>`` -> minified JSON object; values are JSON text already."""
    body = F.transform(
        members, lambda m: F.concat(json_string(m["key"]), F.lit(":"), m["value"])
    )
    return F.concat(F.lit("{"), F.array_join(body, ","), F.lit("}"))


def _keys(members: Column) -> Column:
    return F.transform(members, lambda m: m["key"])


def _place(keys: Column, key: Column) -> Column:
    return (F.array_position(keys, key) - 1).cast("int")


def drop_key(members: Column, hex_text: Column) -> Column:
    """Members without one drawn key; unchanged if there is only one."""
    victim = F.get(
        F.array_sort(_keys(members)), draw(hex_text, 1, 6, F.size(members)).cast("int")
    )
    return F.when(
        F.size(members) > 1, remove_at(members, _place(_keys(members), victim))
    ).otherwise(members)


def renamed(key: Column) -> Column:
    """The other name of a key, NULL for a key without one."""
    name = F.lit(None).cast("string")
    for old, new in KEY_RENAMES.items():
        name = F.when(key == old, F.lit(new)).otherwise(name)
    return name


def renamable(members: Column) -> Column:
    return F.filter(_keys(members), lambda k: k.isin(*KEY_RENAMES))


def rename_key(members: Column, hex_text: Column) -> Column:
    """Members with exactly one drawn key renamed.

    Where the new name already exists, the two become one: at the earlier place,
    with the later value, as in a rebuilt dictionary.
    """

    def rename(members: Column, keys: Column, chosen: Column) -> Column:
        target = renamed(chosen)
        at, twin = _place(keys, chosen), _place(keys, target)

        def entry(place: Column) -> Column:
            return F.struct(target.alias("key"), F.get(members, place)["value"].alias("value"))

        early, late = F.least(at, twin), F.greatest(at, twin)
        return F.when(twin < 0, replace_at(members, at, entry(at))).otherwise(
            remove_at(replace_at(members, early, entry(late)), late)
        )

    options = renamable(members)
    drawn = F.get(options, draw(hex_text, 1, 6, F.greatest(F.size(options), F.lit(1))).cast("int"))
    return F.when(
        F.size(options) > 0, let(rename, members=members, keys=_keys(members), chosen=drawn)
    ).otherwise(members)


def prose_wrap(text: Column, hex_text: Column) -> Column:
    prefixes = F.array(*[F.lit(p) for p in PROSE_PREFIXES])
    return F.concat(
        F.get(prefixes, draw(hex_text, 1, 6, len(PROSE_PREFIXES)).cast("int")), text
    )


def truncate_json(text: Column) -> Column:
    """The first 70 % of the text, two characters at least."""
    keep = F.greatest(F.lit(2), (F.length(text) * F.lit(KEPT_SHARE)).cast("int"))
    return F.substring(text, F.lit(1), keep)


def choose_mode(text: Column, members: Column, hex_text: Column) -> Column:
    """The first mode, in a drawn order, that can change the text; NULL if none can.

    Whether a mode changes the text is known without building its candidate.
    """
    count = F.size(F.coalesce(members, F.array().cast("array<struct<key:string,value:string>>")))
    possible = {
        "digits": text.rlike(DIGIT),
        "drop_key": count > 1,
        "rename_key": (count > 0) & (F.size(renamable(members)) > 0),
        "prose": F.lit(True),
        "truncate": F.length(text) > 2,
    }
    def first_open(order: Column, open_modes: Column) -> Column:
        places = [F.get(order, F.lit(j)) for j in range(len(MODES))]
        found = F.coalesce(*[F.when(F.get(open_modes, p), p) for p in places])
        return F.get(F.array(*[F.lit(m) for m in MODES]), found)

    return let(
        first_open,
        order=shuffled(F.substring(hex_text, 33, 32), len(MODES)),
        open_modes=F.array(*[F.coalesce(possible[m], F.lit(False)) for m in MODES]),
    )


def perturb(text: Column, members: Column, hex_text: Column, mode: Column) -> Column:
    """The text of the chosen mode, always different from ``text``; only it is built."""
    return (
        F.when(mode == "digits", corrupt_digits(text, hex_text))
        .when(mode == "drop_key", join_members(drop_key(members, hex_text)))
        .when(mode == "rename_key", join_members(rename_key(members, hex_text)))
        .when(mode == "prose", prose_wrap(text, hex_text))
        .when(mode == "truncate", truncate_json(text))
        .otherwise(F.substring(text, F.lit(1), F.greatest(F.length(text) - 1, F.lit(0))))
    )
