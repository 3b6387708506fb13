"""JSON Schema as one Catalyst expression: texts are checked without leaving the JVM.

The text is parsed once into a VARIANT.  Every keyword becomes a boolean over the parsed value;
members and items are reached through typed casts, so nothing is printed and parsed again.  The
strict lane (``schema.compile_schema`` over Python's parser) is the yardstick: both know the
same keywords, and a schema that one refuses the other refuses too, but for what is said at
``native_conforms``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmill.functions.binding import let
from fieldmill.functions.schema import compile_schema

#: Levels down to which nested values are spelled alike when ``uniqueItems`` compares them.
SPELLED_LEVELS = 3

_NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*)$"
_WHOLE = r"^(BIGINT|DECIMAL\(\d+,0\))$"


def _yes() -> Column:
    return F.lit(True)


def _no() -> Column:
    return F.lit(False)


class Value:
    """A parsed value in an expression: the variant, and what it is, found out once."""

    def __init__(self, v: Column, members: Column, items: Column, kind: Column):
        self.v, self.members, self.items, self.kind = v, members, items, kind

    @property
    def is_number(self) -> Column:
        return self.kind.rlike(_NUMBER)

    @property
    def is_string(self) -> Column:
        return self.kind == "STRING"

    @property
    def text(self) -> Column:
        return self.v.try_cast("string")

    @property
    def double(self) -> Column:
        return self.v.try_cast("double")

    def whole(self, then: Callable[[Column], Column], otherwise: Column) -> Column:
        """Whole numbers are compared exactly, all others as doubles."""
        return F.when(self.kind.rlike(_WHOLE), then(self.v.try_cast("decimal(38,0)"))).otherwise(otherwise)


Check = Callable[[Value], Column]


def _bound(v: Column, body: Check) -> Column:
    """``body`` over a value that is taken apart once, however often the body looks at it."""
    members, items = v.try_cast("map<string,variant>"), v.try_cast("array<variant>")
    kind = F.when(members.isNotNull() | items.isNotNull(), "").otherwise(F.schema_of_variant(v))
    return let(lambda **parts: body(Value(**parts)), v=v, members=members, items=items, kind=kind)


def _only(applies: Callable[[Value], Column], check: Check) -> Check:
    """A keyword says nothing about values of another type than its own."""
    return lambda x: ~applies(x) | F.coalesce(check(x), _no())


def _is_object(x: Value) -> Column:
    return x.members.isNotNull()


def _is_array(x: Value) -> Column:
    return x.items.isNotNull()


def _is_integer(x: Value) -> Column:
    finite = F.abs(x.double) < F.lit(float("inf"))
    return x.is_number & x.whole(lambda n: _yes(), finite & (x.double == F.floor(x.double)))


_KINDS: dict[str, Check] = {
    "object": _is_object,
    "array": _is_array,
    "string": lambda x: x.is_string,
    "boolean": lambda x: x.kind == "BOOLEAN",
    "null": lambda x: x.kind == "VOID",
    "number": lambda x: x.is_number,
    "integer": _is_integer,
}


def _type(names: Any) -> Check:
    names = [names] if isinstance(names, str) else list(names)

    def check(x: Value) -> Column:
        found = _no()
        for name in names:
            found = found | _KINDS[name](x)
        return found

    return check


def _fits(number: int) -> bool:
    return abs(number) < 10**38


def _exactly(number: int) -> Column:
    return F.lit(Decimal(number)).cast("decimal(38,0)")


def _limit(number: float, least: bool, open_end: bool) -> Check:
    """A bound on numbers; whole ones meet the next whole number inside the bound."""
    if least:
        inner = math.floor(number) + 1 if open_end else math.ceil(number)
    else:
        inner = math.ceil(number) - 1 if open_end else math.floor(number)

    def over(a: Column, b: Column, open_end: bool) -> Column:
        if least:
            return a > b if open_end else a >= b
        return a < b if open_end else a <= b

    def check(x: Value) -> Column:
        plain = over(x.double, F.lit(float(number)), open_end)
        if not _fits(inner):
            return plain
        return x.whole(lambda n: over(n, _exactly(inner), False), plain)

    return _only(lambda x: x.is_number, check)


def _size(least: bool, count: int, applies: Callable[[Value], Column], size: Check) -> Check:
    return _only(applies, lambda x: (size(x) >= count) if least else (size(x) <= count))


def _pattern(text: str) -> Check:
    if "(?P" in text:
        raise ValueError(f"named groups are not known to both parsers: {text}")
    # as in the strict lane: classes beyond ASCII, and only a line feed ends a line
    return _only(lambda x: x.is_string, lambda x: x.text.rlike("(?dU)" + text))


def _same(value: Any) -> Check:
    """Equal as JSON Schema has it: 1 is 1.0 but not true, objects in any order of keys."""
    if value is None:
        return _KINDS["null"]
    if isinstance(value, bool):
        return lambda x: (x.kind == "BOOLEAN") & (x.text == ("true" if value else "false"))
    if isinstance(value, str):
        return lambda x: x.is_string & (x.text == value)
    if isinstance(value, int) and _fits(value):
        return lambda x: x.is_number & x.whole(lambda n: n == _exactly(value), x.double == float(value))
    if isinstance(value, (int, float)):
        return lambda x: x.is_number & (x.double == float(value))
    if isinstance(value, list):
        inner = [_same(item) for item in value]
        return lambda x: _is_array(x) & _all(
            [F.size(x.items) == len(inner)]
            + [F.when(F.size(x.items) > i, _bound(F.get(x.items, F.lit(i)), c)) for i, c in enumerate(inner)]
        )
    fields = {key: _same(child) for key, child in value.items()}
    return lambda x: _is_object(x) & _all(
        [F.size(x.members) == len(fields)] + [_member(x, key, c, _no()) for key, c in fields.items()]
    )


def _all(checks: list[Column]) -> Column:
    found = _yes()
    for check in checks:
        found = found & F.coalesce(check, _no())
    return found


def _member(x: Value, key: str, check: Check, absent: Column) -> Column:
    has = F.map_contains_key(x.members, F.lit(key))
    return F.when(has, _bound(F.element_at(x.members, F.lit(key)), check)).otherwise(absent)


def _among(values: list) -> Check:
    checks = [_same(value) for value in values]

    def check(x: Value) -> Column:
        found = _no()
        for one in checks:
            found = found | F.coalesce(one(x), _no())
        return found

    return check


def _spelled(v: Column, levels: int = SPELLED_LEVELS) -> Column:
    """A text that is the same for values that are equal."""

    def number(x: Value) -> Column:
        # a number that is whole is spelled as such, whatever its type
        plain = F.coalesce(x.double, F.lit(0.0))
        short = (F.abs(plain) < 1e18) & (plain == F.floor(plain))
        other = F.when(short, F.floor(plain).cast("string")).otherwise(plain.cast("string"))
        return F.concat(F.lit("n"), x.whole(lambda n: n.cast("string"), other))

    def spell(x: Value) -> Column:
        scalar = F.when(x.is_number, number(x)).otherwise(F.to_json(x.v))
        if levels == 0:
            return F.when(x.kind == "", F.to_json(x.v)).otherwise(scalar)
        items = F.concat(
            F.lit("["), F.array_join(F.transform(x.items, lambda i: _spelled(i, levels - 1)), ","), F.lit("]")
        )
        keys = F.array_sort(F.map_keys(x.members))
        pairs = F.transform(
            keys,
            lambda k: F.concat(
                F.to_json(F.array(k)), F.lit(":"), _spelled(F.element_at(x.members, k), levels - 1)
            ),
        )
        members = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
        return F.when(_is_array(x), items).when(_is_object(x), members).otherwise(scalar)

    return _bound(v, spell)


def _distinct(wanted: bool) -> Check:
    if not wanted:
        return lambda x: _yes()
    return _only(
        _is_array,
        lambda x: F.size(F.array_distinct(F.transform(x.items, lambda i: _spelled(i)))) == F.size(x.items),
    )


_SIMPLE: dict[str, Callable[[Any], Check]] = {
    "type": _type,
    "enum": _among,
    "const": _same,
    "pattern": _pattern,
    "minimum": lambda n: _limit(n, True, False),
    "maximum": lambda n: _limit(n, False, False),
    "exclusiveMinimum": lambda n: _limit(n, True, True),
    "exclusiveMaximum": lambda n: _limit(n, False, True),
    "minLength": lambda n: _size(True, n, lambda x: x.is_string, lambda x: F.length(x.text)),
    "maxLength": lambda n: _size(False, n, lambda x: x.is_string, lambda x: F.length(x.text)),
    "minItems": lambda n: _size(True, n, _is_array, lambda x: F.size(x.items)),
    "maxItems": lambda n: _size(False, n, _is_array, lambda x: F.size(x.items)),
    "minProperties": lambda n: _size(True, n, _is_object, lambda x: F.size(x.members)),
    "maxProperties": lambda n: _size(False, n, _is_object, lambda x: F.size(x.members)),
    "uniqueItems": _distinct,
    "required": lambda keys: _only(
        _is_object, lambda x: _all([F.map_contains_key(x.members, F.lit(key)) for key in keys])
    ),
}


class _Compiler:
    """Checks of one schema document; ``$ref`` points into that document and is put in its place."""

    def __init__(self, document: dict):
        self.document = document
        self.open: list[str] = []

    def check(self, schema: dict | bool) -> Check:
        if isinstance(schema, bool):
            return lambda x: F.lit(schema)
        checks = [_SIMPLE[key](value) for key, value in schema.items() if key in _SIMPLE]
        for key in ("allOf", "anyOf", "oneOf", "not", "items", "$ref"):
            if key in schema:
                checks.append(self.nested(key, schema[key]))
        if "properties" in schema or "additionalProperties" in schema:
            checks.append(self.members(schema))
        return lambda x: _all([check(x) for check in checks])

    def nested(self, key: str, value: Any) -> Check:
        if key == "$ref":
            return self.reference(value)
        if key == "not":
            inner = self.check(value)
            return lambda x: ~inner(x)
        if key == "items":
            inner = self.check(value)
            return _only(_is_array, lambda x: F.forall(x.items, lambda i: _bound(i, inner)))
        parts = [self.check(part) for part in value]
        if key == "allOf":
            return lambda x: _all([part(x) for part in parts])
        least = 1 if key == "anyOf" else None

        def check(x: Value) -> Column:
            held = F.lit(0)
            for part in parts:
                held = held + part(x).cast("int")
            return held >= least if least else held == 1

        return check

    def members(self, schema: dict) -> Check:
        fields = {key: self.check(part) for key, part in schema.get("properties", {}).items()}
        extra = schema.get("additionalProperties", True)
        other = self.check(extra)

        def check(x: Value) -> Column:
            found = [_member(x, key, part, _yes()) for key, part in fields.items()]
            if extra is not True and extra != {}:
                known = [F.lit(key) for key in fields]
                found.append(
                    F.forall(
                        F.map_entries(x.members),
                        lambda e: (e["key"].isin(*known) if known else _no()) | _bound(e["value"], other),
                    )
                )
            return _all(found)

        return _only(_is_object, check)

    def reference(self, pointer: str) -> Check:
        if pointer in self.open:
            raise ValueError(f"a schema that holds itself has no finite expression: {pointer}")
        node: Any = self.document
        for step in pointer.split("/")[1:]:
            node = node[step.replace("~1", "/").replace("~0", "~")]
        self.open.append(pointer)
        found = self.check(node)
        self.open.pop()
        return found


def parsed(text: Column) -> Column:
    """The text as a VARIANT, null where it is no JSON value or more than one.

    Spark's parser stops behind the first value.  The text therefore stands inside an object,
    before a member that is named by the text's own digest: whatever ends the object early or
    adds to it shows.
    """
    mark = F.md5(text)
    whole = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(',"'), mark, F.lit('":0}')))

    def alone(members: Column, mark: Column) -> Column:
        two = (F.size(members) == 2) & F.map_contains_key(members, mark)
        return F.when(two, F.element_at(members, F.lit("v")))

    return let(alone, members=whole.try_cast("map<string,variant>"), mark=mark)


def native_conforms(text: Column, schema: dict | None) -> Column:
    """Whether a text is JSON that the schema accepts; null and what is no JSON are not.

    No schema: everything that parses conforms.  The keywords are those of ``compile_schema``,
    which also refuses the others.  Differences to the strict lane: a schema that refers to
    itself, or a pattern with named groups, is refused; an object that names a key twice is no
    JSON unless the session sets ``spark.sql.variant.allowDuplicateKeys``; nor are numbers of
    over 1,000 digits, the names NaN and Infinity, nesting beyond 1,000 levels and texts of over
    128 MB; ``uniqueItems`` tells
    numbers apart by their spelling (1, 1.0) where they lie more than three levels deep.
    """
    compile_schema(schema)  # refuses unknown keywords, types and references
    value = parsed(text)
    if schema is None:
        return value.isNotNull()
    check = _Compiler(schema).check(schema)
    return F.coalesce(let(lambda v: F.when(v.isNotNull(), _bound(v, check)), v=value), _no())
