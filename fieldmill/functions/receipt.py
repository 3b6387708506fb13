"""Receipts with a known shape: constants, generator, layout and native flatten."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmill.functions.binding import let
from fieldmill.functions.draws import cut, digest, draw
from fieldmill.functions.text import json_string, normalize_value, strip_thousands

# Vocabulary, tax rates, page size and ranges of the synthetic domain.
VENDORS = (
    "GREEN MARKET", "CITY DELI", "SUNRISE CAFE", "NORTH BAKERY", "STAR GROCERY",
    "RIVER BISTRO", "GOLDEN NOODLES", "URBAN COFFEE", "FRESH CORNER", "OLD MILL PUB",
)
PRODUCTS = (
    "espresso", "latte", "green tea", "croissant", "bagel", "cheesecake",
    "orange juice", "salad bowl", "tomato soup", "club sandwich", "pasta",
    "pizza slice", "burger", "fries", "spring rolls", "ice cream", "brownie",
    "mineral water", "lemonade", "hot chocolate",
)
TAX_PERCENT = (5, 8, 10)
FIRST_YEAR, YEARS, MONTHS, DAYS = 2024, 3, 12, 28
FEWEST_ITEMS, MOST_ITEMS = 2, 6
MOST_COUNT = 4
LOWEST_CENTS, HIGHEST_CENTS = 150, 2500
IMAGE_SIZE = (420, 560)
EVAL_START = 1_000_000
DEFAULT_TRAIN, DEFAULT_EVAL = 256, 64

_ITEM = {
    "type": "object",
    "additionalProperties": False,
    "required": ["name", "count", "price"],
    "properties": {
        "name": {"type": "string"},
        "count": {"type": "string"},
        "price": {"type": "string"},
    },
}
ANNOTATED_SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "required": ["menu", "subtotal", "tax", "total"],
    "properties": {
        "menu": {"type": "array", "description": "line items on the receipt", "items": _ITEM},
        "subtotal": {"type": "string", "description": "subtotal amount"},
        "tax": {"type": "string", "description": "tax amount"},
        "total": {"type": "string", "description": "grand total amount"},
    },
}
SYNTHETIC_SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "required": ["vendor", "date", "items", "subtotal", "tax", "total"],
    "properties": {
        "vendor": {"type": "string", "description": "store name printed at the top"},
        "date": {"type": "string", "pattern": r"^\d{4}-\d{2}-\d{2}$"},
        "items": {"type": "array", "description": "line items on the receipt", "items": _ITEM},
        "subtotal": {"type": "string", "description": "sum of line prices"},
        "tax": {"type": "string", "description": "tax amount"},
        "total": {"type": "string", "description": "grand total amount"},
    },
}
ANNOTATED_TYPE = (
    "menu array<struct<name:string,count:string,price:string>>, "
    "subtotal string, tax string, total string"
)


def money(cents: Column) -> Column:
    """Whole cents as text with two decimals."""
    return F.concat(
        F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")
    )


def _pick(words: tuple[str, ...], position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (position + 1).cast("int"))


def with_receipt(df: DataFrame, key: str = "index", seed: int = 0) -> DataFrame:
    """Adds ``receipt`` (struct) and the layout jitter, drawn per ``(seed, key)``."""
    salt = f"receipt|{seed}"
    k = F.col(key)
    span = HIGHEST_CENTS - LOWEST_CENTS + 1
    drawn = df.withColumns(
        {
            "_head": digest(salt, k).cast("binary"),
            "_order": digest(salt + "|order", k, blocks=4).cast("binary"),
            "_lines": digest(salt + "|lines", k, blocks=2).cast("binary"),
        }
    )
    head, lines = F.col("_head"), F.col("_lines")
    # Spark interprets a lambda and all below it, while plain columns are compiled: the draws are
    # plain columns, each referred to several times, so that none is inlined.  A step of many
    # columns has one small ``let``: without a lambda Spark fuses the steps into one method, too
    # large for the JVM to compile.
    # Products in drawn order: six digits and the place decide, the name comes along.
    order = F.sort_array(
        F.array(
            *[
                F.concat(F.substring("_order", 1 + 6 * i, 6), F.lit(f"{i:02d}{name}".encode()))
                for i, name in enumerate(PRODUCTS)
            ]
        )
    )
    slots = range(MOST_ITEMS)
    picked = drawn.withColumns(
        {
            "_order": order,
            "_n": let(
                lambda more: (F.lit(FEWEST_ITEMS) + more).cast("int"),
                more=draw(head, 19, 4, MOST_ITEMS - FEWEST_ITEMS + 1),
            ),
            **{f"_count{j}": F.lit(1) + draw(lines, 1 + 10 * j, 4, MOST_COUNT) for j in slots},
            **{f"_unit{j}": F.lit(LOWEST_CENTS) + draw(lines, 5 + 10 * j, 6, span) for j in slots},
        }
    )
    sums = [F.when(F.col("_n") > j, F.col(f"_count{j}") * F.col(f"_unit{j}")).otherwise(F.lit(0)) for j in slots]
    priced = picked.withColumns({f"_cents{j}": cents for j, cents in zip(slots, sums)}).withColumn(
        "_subtotal", reduce(add, [F.col(f"_cents{j}") for j in slots])
    )
    rate = F.element_at(
        F.array(*[F.lit(p) for p in TAX_PERCENT]),
        (draw(head, 23, 4, len(TAX_PERCENT)) + 1).cast("int"),
    )
    taxed = priced.withColumn("_tax", F.floor((F.col("_subtotal") * rate * 2 + 100) / 200))
    date = F.concat_ws(
        "-",
        (F.lit(FIRST_YEAR) + draw(head, 7, 4, YEARS)).cast("string"),
        F.lpad((draw(head, 11, 4, MONTHS) + 1).cast("string"), 2, "0"),
        F.lpad((draw(head, 15, 4, DAYS) + 1).cast("string"), 2, "0"),
    )
    receipt = F.struct(
        _pick(VENDORS, draw(head, 1, 6, len(VENDORS))).alias("vendor"),
        date.alias("date"),
        F.slice(
            F.array(
                *[
                    F.struct(
                        F.substring(F.get("_order", F.lit(j)), 9, 99).cast("string").alias("name"),
                        F.col(f"_count{j}").cast("string").alias("count"),
                        money(F.col(f"_cents{j}")).alias("price"),
                    )
                    for j in slots
                ]
            ),
            F.lit(1),
            F.col("_n"),
        ).alias("items"),
        money(F.col("_subtotal")).alias("subtotal"),
        let(lambda tax: money(tax), tax=F.col("_tax")).alias("tax"),
        money(F.col("_subtotal") + F.col("_tax")).alias("total"),
    )
    return taxed.withColumn("receipt", receipt).drop(
        "_head", "_order", "_lines", "_n", "_subtotal", "_tax",
        *[f"_{part}{j}" for part in ("count", "unit", "cents") for j in slots],
    )


def minify_json(struct: Column) -> Column:
    """Minified JSON of a struct: field order kept, no ASCII escapes, nulls kept."""
    return F.to_json(struct, {"ignoreNullFields": "false"})


def struct_members(struct: Column, dtype: T.StructType) -> Column:
    """Top-level members of a typed struct as ``array<struct<key,value>>``, value as JSON text."""

    def text(field: T.StructField) -> Column:
        value = struct[field.name]
        if isinstance(field.dataType, T.StringType):
            return F.coalesce(json_string(value), F.lit("null"))
        return F.coalesce(F.to_json(value, {"ignoreNullFields": "false"}), F.lit("null"))

    return F.array(
        *[F.struct(F.lit(f.name).alias("key"), text(f).alias("value")) for f in dtype.fields]
    )


def layout_lines(df: DataFrame, key: str = "index", seed: int = 0) -> DataFrame:
    """Receipt rows -> one row per printed line: ``(key, line_no, x, y, text)``.

    Same paddings and line heights as the drawn page; x and y carry a per-receipt
    jitter, each price line and the last line one of their own.
    """

    def left(text: Column, width: int) -> Column:
        return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(text))))

    def right(text: Column, width: int) -> Column:
        return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(text))), text)

    def line(text: Column, y: Column | int, dx: Column | int = 0) -> Column:
        down = F.lit(y) if isinstance(y, int) else y
        shift = F.lit(dx) if isinstance(dx, int) else dx
        return F.struct(
            text.alias("text"), down.cast("int").alias("y"), shift.cast("int").alias("x")
        )

    r = F.col("receipt")
    drawn = df.withColumn("_page", digest(f"receipt|{seed}|page", F.col(key), blocks=2))
    page = F.col("_page")
    x0 = F.lit(18) + draw(page, 1, 4, 23)
    y0 = F.lit(16) + draw(page, 5, 4, 21)
    count = F.size(r["items"])
    top = 28 + 22 + 22
    below = F.lit(top) + count * 42
    # One jitter of four hex digits per item; the page's digits hold twelve of them, items
    # beyond draw their own.
    own = F.slice(cut(F.substring(page, 13, 48), 4, 12), F.lit(1), F.least(count, F.lit(12)))
    further = F.transform(
        F.sequence(F.lit(12), count - 1),
        lambda i: F.substring(digest(f"receipt|{seed}|item", F.col(key), i), 1, 4),
    )
    digits = F.when(count > 12, F.concat(own, further)).otherwise(own)
    priced = F.arrays_zip(r["items"].alias("item"), digits.alias("digits"))
    items = F.flatten(
        F.transform(
            priced,
            lambda z, i: F.array(
                line(
                    F.concat(
                        left(F.substring(z["item"]["name"], 1, 18), 18),
                        F.lit(" x"),
                        z["item"]["count"],
                    ),
                    F.lit(top) + i * 42,
                ),
                line(
                    right(z["item"]["price"], 28),
                    F.lit(top + 22) + i * 42,
                    F.coalesce(draw(z["digits"], 1, 4, 9), F.lit(0)),
                ),
            ),
        )
    )
    rule = F.lit("-" * 34)
    lines = F.concat(
        F.array(
            line(r["vendor"], 0),
            line(F.concat(F.lit("DATE: "), r["date"]), 28),
            line(rule, 50),
        ),
        items,
        F.array(
            line(rule, below),
            line(F.concat(F.lit("SUBTOTAL"), right(r["subtotal"], 20)), below + 22),
            line(F.concat(F.lit("TAX"), right(r["tax"], 25)), below + 44),
            line(F.concat(F.lit("TOTAL"), right(r["total"], 23)), below + 66),
            line(F.lit("THANK YOU!"), below + 94, draw(page, 9, 4, 61)),
        ),
    )
    placed = drawn.select(key, x0.alias("_x0"), y0.alias("_y0"), F.posexplode(lines))
    return placed.select(
        key,
        F.col("pos").alias("line_no"),
        (F.col("_x0") + F.col("col.x")).cast("int").alias("x"),
        (F.col("_y0") + F.col("col.y")).cast("int").alias("y"),
        F.col("col.text").alias("text"),
    )


def flatten_struct(col: Column, dtype: T.DataType) -> Column:
    """Set of ``struct<path,value>`` of a typed value, natively; NULL leaves read ``none``."""

    def walk(value: Column, kind: T.DataType, path: str) -> Column:
        if isinstance(kind, T.StructType):
            return F.concat(
                *[
                    walk(value[f.name], f.dataType, f"{path}.{f.name}" if path else f.name)
                    for f in kind.fields
                ]
            )
        if isinstance(kind, T.ArrayType):
            inner = F.transform(value, lambda item: walk(item, kind.elementType, f"{path}[]"))
            empty = F.array().cast("array<struct<path:string,value:string>>")
            return F.coalesce(F.flatten(inner), empty)
        return F.array(
            F.struct(
                F.lit(path).alias("path"),
                F.coalesce(value.cast("string"), F.lit("none")).alias("value"),
            )
        )

    return F.array_distinct(
        F.transform(
            walk(col, dtype, ""),
            lambda p: F.struct(p["path"].alias("path"), normalize_value(p["value"]).alias("value")),
        )
    )


def _objects(text: Column, kind: str) -> Column:
    """The objects of a JSON list, or the one object there is, as ``array<kind>``.

    A list of nothing but objects is parsed once, straight into its type.  In any other list
    each item's own type says whether it is an object; a string that looks like one is none.
    """
    lone = F.startswith(F.ltrim(text), F.lit("{"))
    listed = F.when(lone, F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    kinds = F.try_variant_get(F.try_parse_json(listed), "$", "array<variant>")

    def chosen(part: Column, item: Column) -> Column:
        # items without a known type (an object that repeats a key) go by their first character
        is_object = F.coalesce(F.startswith(F.schema_of_variant(item), F.lit("OBJECT")), F.lit(True))
        return F.when(F.startswith(part, F.lit("{")) & is_object, part)

    nothing = F.array().cast("array<variant>")
    parts = F.zip_with(
        F.from_json(listed, "array<string>"), F.coalesce(kinds, nothing), chosen
    )
    mixed = F.transform(F.array_compact(parts), lambda part: F.from_json(part, kind))
    return F.array_compact(F.coalesce(F.from_json(listed, f"array<{kind}>"), mixed))


def merge_objects(text: Column) -> Column:
    """JSON object, or list of objects, as one ``map<string,string>``; the last key wins, in one
    object as among several."""
    pairs = F.flatten(F.transform(_objects(text, "map<string,string>"), lambda part: F.map_entries(part)))

    def last_of_each(pairs: Column) -> Column:
        return let(
            lambda pairs, keys: F.map_from_entries(
                F.filter(
                    pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["key"])
                )
            ),
            pairs=pairs,
            keys=F.transform(pairs, lambda p: p["key"]),
        )

    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(let(last_of_each, pairs=pairs), empty)


def menu_items(text: Column) -> Column:
    """JSON list (or one object) of raw menu lines -> ``array<struct<name,count,price>>``."""

    def item(line: Column) -> Column:
        return F.struct(
            F.coalesce(line["nm"], F.lit("")).alias("name"),
            F.coalesce(strip_thousands(line["cnt"]), F.lit("")).alias("count"),
            F.coalesce(strip_thousands(line["price"]), F.lit("")).alias("price"),
        )

    empty = F.array().cast("array<struct<name:string,count:string,price:string>>")
    lines = _objects(text, "struct<nm:string,cnt:string,price:string>")
    return F.coalesce(F.transform(lines, item), empty)


def normalize_ground_truth(text: Column) -> Column:
    """Native twin of ``normalize_annotation`` for annotations whose leaves are strings."""

    def amount(group: Column, key: str) -> Column:
        last = F.try_element_at(F.array_compact(group[key]), F.lit(-1))
        return F.coalesce(strip_thousands(last), F.lit(""))

    def target(menu: Column, subtotal: Column, total: Column) -> Column:
        return F.struct(
            menu.alias("menu"),
            amount(subtotal, "subtotal_price").alias("subtotal"),
            amount(subtotal, "tax_price").alias("tax"),
            amount(total, "total_price").alias("total"),
        )

    def groups(body: Column) -> Column:
        return let(
            target,
            menu=menu_items(body["menu"]),
            subtotal=_objects(body["sub_total"], "struct<subtotal_price:string,tax_price:string>"),
            total=_objects(body["total"], "struct<total_price:string>"),
        )

    shape = "gt_parse struct<menu:string,sub_total:string,total:string>"
    return let(groups, body=F.from_json(text, shape)["gt_parse"])
