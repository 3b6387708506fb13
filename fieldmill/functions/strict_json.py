"""Strict JSON parsing of arbitrary model output, one Arrow batch at a time.

Spark's own JSON functions accept texts a strict parser refuses and refuse some
it accepts, reorder keys and rewrite numbers, so they cannot judge model output.
The UDFs here only parse and flatten; matching, counting, joining and ranking
are native expressions on what they return.

The UDFs are marked nondeterministic so that a later filter on one of their
fields does not make Spark evaluate them twice.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmill.functions.schema import compile_schema
from fieldmill.functions.text import BLANKS

# The interpreter refuses to read longer integers until it is told otherwise.
_LONG_DIGITS = re.compile(r"\d{4301}")
_NOT_NUMERIC = re.compile(r"[^\d.\-]")
# Short enough that its own digits are what four decimals of the double print.
_SHORT_NUMBER = re.compile(r"(?:0|[1-9][0-9]{0,10})(?:\.[0-9]{1,4})?")


class MISSING:
    """Marks text that is no JSON.  A class, so that it stays itself in every worker."""


class TOO_DEEP:  # noqa: N801
    """Marks text that nests deeper than the parser can follow."""


SCORED_TYPE = (
    "gold_valid boolean, json_valid boolean, schema_valid boolean, exact_match boolean, "
    "gold_fields array<string>, pred_fields array<string>"
)


def parse_text(text: str | None) -> Any:
    """The parsed value, or ``MISSING`` for NULL and anything not JSON.

    Integers may have any number of digits.  Nesting beyond what the parser can hold counts
    as ``TOO_DEEP``, which is no value either.
    """
    if text is None:
        return MISSING
    try:
        return json.loads(text)
    except RecursionError:
        return TOO_DEEP
    except ValueError:
        if not _LONG_DIGITS.search(text):
            return MISSING
    sys.set_int_max_str_digits(0)  # for this worker, from the first such text on
    try:
        return json.loads(text)
    except ValueError:
        return MISSING
    except RecursionError:
        return TOO_DEEP


def is_value(parsed: Any) -> bool:
    return parsed is not MISSING and parsed is not TOO_DEEP


def _cut_block(raw: str | None) -> str | None:
    """First ``{`` to last ``}`` of a raw answer."""
    if raw is None:
        return None
    first, last = raw.find("{"), raw.rfind("}")
    return raw[first : last + 1] if 0 <= first < last else None


def _parse_block(raw: str | None) -> Any:
    """The block of a raw answer, which must be one object."""
    value = parse_text(_cut_block(raw))
    return value if isinstance(value, dict) else MISSING


def utf8(text: str) -> str:
    """Lone surrogates (legal JSON escapes, no legal UTF-8) become visible escapes."""
    return text if text.isascii() else text.encode("utf-8", "backslashreplace").decode()


@lru_cache(maxsize=1 << 16)
def _canonical_leaf(text: str) -> str:
    if _SHORT_NUMBER.fullmatch(text):
        return text.rstrip("0").rstrip(".") if "." in text else text
    text = text.strip(BLANKS)
    digits = _NOT_NUMERIC.sub("", text)
    if any(c.isdigit() for c in digits):
        try:
            return f"{float(digits):.4f}".rstrip("0").rstrip(".")
        except ValueError:
            pass
    return utf8(text.lower())


@lru_cache(maxsize=1 << 12)
def _token_head(path: str) -> str:
    """The length prefix keeps path and value apart in one string."""
    path = utf8(path)
    return f"{len(path)}:{path}"


def leaves(document: Any) -> Iterator[tuple[str, str]]:
    """``(path, canonical value)`` of every leaf, copies included."""
    todo = [("", document)]
    while todo:
        path, node = todo.pop()
        if isinstance(node, dict):
            parts = [(f"{path}.{key}" if path else key, child) for key, child in node.items()]
        elif isinstance(node, list):
            path += "[]"
            parts = [(path, child) for child in node]
        else:
            parts = [(path, node)]
        for place, child in parts:
            if isinstance(child, str):
                yield place, _canonical_leaf(child)
            elif isinstance(child, (dict, list)):
                todo.append((place, child))
            else:
                yield place, _canonical_leaf(str(child))


class _Fields(dict):
    """``path -> key -> text -> field`` of members met before; most recur from row to row.

    Plain dictionaries, which cost a leaf least.  They hold short texts and start anew when full.
    """

    MOST, LONGEST = 1 << 16, 64

    def __init__(self) -> None:
        self.held = 0

    def under(self, path: str) -> dict[str, dict[str, str]]:
        if self.held >= self.MOST:
            self.clear()
            self.held = 0
        return self.setdefault(path, {})

    def made(self, keys: dict[str, dict[str, str]], path: str, key: str, text: str) -> str:
        field = _token_head(f"{path}.{key}" if path else key) + _canonical_leaf(text)
        if len(text) <= self.LONGEST and len(key) <= self.LONGEST and self.held < self.MOST:
            keys.setdefault(key, {})[text] = field
            self.held += 1
        return field


_fields = _Fields()


def _tokens(document: Any) -> list[str]:
    """The set of fields, each as one string: ``leaves`` without a step of its own per leaf."""
    found = set()
    todo = [("", document)]
    while todo:
        path, node = todo.pop()
        if isinstance(node, dict):
            keys = _fields.under(path)
            for key, child in node.items():
                if isinstance(child, (dict, list)):
                    todo.append((f"{path}.{key}" if path else key, child))
                    continue
                text = child if isinstance(child, str) else str(child)
                try:
                    found.add(keys[key][text])
                except KeyError:
                    found.add(_fields.made(keys, path, key, text))
        elif isinstance(node, list):
            path += "[]"
            for child in node:
                if isinstance(child, (dict, list)):
                    todo.append((path, child))
                else:
                    found.add(_token_head(path) + _canonical_leaf(str(child)))
        else:
            found.add(_token_head(path) + _canonical_leaf(str(node)))
    return list(found)


# Made once: ``json.dumps`` makes an encoder for every call that wants other than its own settings.
_minified = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
_quoted = json.encoder.encode_basestring


def _compact(value: Any) -> str:
    text = _quoted(value) if isinstance(value, str) else _minified(value)
    if text.isascii():
        return text
    try:
        text.encode("utf-8")
    except UnicodeEncodeError:
        text = json.dumps(value, separators=(",", ":"))
    return text


def _spelled(leaf: Any) -> Any:
    """Numbers and truth values that compare equal get one spelling."""
    if isinstance(leaf, bool) or (isinstance(leaf, float) and leaf.is_integer()):
        return int(leaf)
    return leaf


def _comparable(value: Any) -> Any:
    """A copy with every leaf in its one spelling; walks level by level, however deep."""
    holder = [value]
    todo: list[tuple[Any, Any]] = [(holder, 0)]
    while todo:
        parent, at = todo.pop()
        node = parent[at]
        if isinstance(node, dict):
            parent[at] = copy = dict(node)
            todo.extend((copy, key) for key in copy)
        elif isinstance(node, list):
            parent[at] = copy = list(node)
            todo.extend((copy, i) for i in range(len(copy)))
        else:
            parent[at] = _spelled(node)
    return holder[0]


def _canonical(value: Any) -> str:
    return json.dumps(_comparable(value), sort_keys=True, separators=(",", ":"))


def _struct(rows: list[tuple], kind: pa.StructType) -> pa.StructArray:
    """Rows of plain values as an Arrow struct array, column by column."""
    fields = [kind.field(i) for i in range(kind.num_fields)]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.StructArray.from_arrays(
        [pa.array(list(c), type=f.type) for c, f in zip(columns, fields)], fields=fields
    )


def _arrow_type(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(T.StructType.fromDDL(ddl))


def _pairs(value: Any) -> list[dict[str, str]]:
    return [{"path": utf8(p), "value": v} for p, v in sorted(set(leaves(value)))]


def _members(value: Any) -> list[tuple[str, str]] | None:
    if not isinstance(value, dict):
        return None
    return [(utf8(key), _compact(child)) for key, child in value.items()]


# What a parse can give: type and function of the parsed value.
_PARTS = {
    "canonical": ("string", _canonical),
    "minified": ("string", _compact),
    "pairs": ("array<struct<path:string,value:string>>", _pairs),
    "members": ("array<struct<key:string,value:string>>", _members),
}


def parse_json(
    col: Column,
    *parts: str,
    schema: dict | None = None,
    block: bool = False,
) -> Column:
    """One strict parse of a JSON column: ``struct<valid, schema_valid, part...>``.

    ``block=True`` first cuts the ``{...}`` block out of a raw answer and wants an
    object; otherwise the whole text must be JSON.  Without a schema every parsed
    value conforms.  Parts: ``canonical`` (equal for equal values), ``minified``
    (keys in their own order), ``pairs`` (set of path and value), ``members``
    (top-level keys with compact JSON text; NULL unless the value is an object).
    """
    conforms = compile_schema(schema)
    read = _parse_block if block else parse_text
    ddl = ", ".join(
        ["valid boolean", "schema_valid boolean", *[f"{p} {_PARTS[p][0]}" for p in parts]]
    )
    kind = _arrow_type(ddl)
    makers = [_PARTS[p][1] for p in parts]
    failed = (False, False, *[None] * len(parts))

    @F.arrow_udf(ddl)
    def parse(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            value = read(text)
            rows.append(
                failed
                if not is_value(value)
                else (True, conforms(value), *[make(value) for make in makers])
            )
        return _struct(rows, kind)

    return parse.asNondeterministic()(col)


def parse_pair(gold: Column, raw: Column, schema: dict | None = None) -> Column:
    """Gold text and raw answer parsed in one pass, flattened to comparable fields."""
    conforms = compile_schema(schema)
    kind = _arrow_type(SCORED_TYPE)

    @F.arrow_udf(SCORED_TYPE)
    def parse(golds: pa.Array, raws: pa.Array) -> pa.Array:
        rows = []
        before = gold = MISSING
        gold_fields: list[str] = []
        for gold_text, raw_text in zip(golds.to_pylist(), raws.to_pylist()):
            if gold_text != before:  # the runs of a sweep repeat each gold
                before, gold = gold_text, parse_text(gold_text)
                gold_fields = _tokens(gold) if is_value(gold) else []
            block = _cut_block(raw_text)
            # an answer that repeats the gold text needs no parse of its own
            if block is not None and block == gold_text and isinstance(gold, dict):
                pred = gold
            else:
                pred = _parse_block(block)
            same = is_value(pred) and is_value(gold) and pred == gold
            if same:
                pred_fields = gold_fields
            else:
                pred_fields = _tokens(pred) if is_value(pred) else []
            rows.append(
                (
                    is_value(gold),
                    is_value(pred),
                    is_value(pred) and conforms(pred),
                    same,
                    gold_fields,
                    pred_fields,
                )
            )
        return _struct(rows, kind)

    return parse.asNondeterministic()(gold, raw)


def extract_json(raw: Column) -> Column:
    """Minified object inside a raw answer, keys in their own order; NULL if none."""
    return parse_json(raw, "minified", block=True)["minified"]


def flatten_fields(col: Column) -> Column:
    """Set of ``struct<path,value>`` of a JSON text; list positions are erased."""
    return parse_json(col, "pairs")["pairs"]


TARGET_TYPE = "target_json string, bad_reason string"


# Where the fields of a receipt stand in an annotation, and which are amounts.
_LINE_FIELDS = (("name", "nm", False), ("count", "cnt", True), ("price", "price", True))
_SUM_FIELDS = (
    ("subtotal", "sub_total", "subtotal_price"),
    ("tax", "sub_total", "tax_price"),
    ("total", "total", "total_price"),
)


class BadAnnotation(Exception):
    """An annotation whose shape cannot hold a receipt."""


def _objects(node: Any) -> list[dict]:
    """The objects at a place that may hold one or a list of them."""
    return [part for part in (node if isinstance(node, list) else (node,)) if isinstance(part, dict)]


def _last(parts: list[dict], key: str, amount: bool) -> Any:
    """The key's value in the last object that has it; amounts lose their separators."""
    for part in reversed(parts):
        if key in part:
            found = part[key]
            plain = amount and isinstance(found, str)
            return "".join(found.split(",")).strip(BLANKS) if plain else found
    return ""


def _receipt_target(annotation: Any) -> dict:
    """The receipt of one parsed annotation, read off the tables above.

    Anything but an object is the empty receipt; an object without a usable ``gt_parse`` or
    ``menu`` raises BadAnnotation.
    """
    roots = _objects(annotation) if not isinstance(annotation, list) else []
    body = roots[0].get("gt_parse", {}) if roots else {}
    if not isinstance(body, dict):
        raise BadAnnotation("gt_parse is not an object")
    menu = body.get("menu", [])
    if not isinstance(menu, (dict, list, str)):
        raise BadAnnotation("menu is neither a list nor an object")
    target: dict[str, Any] = {
        "menu": [
            {name: _last([line], key, amount) for name, key, amount in _LINE_FIELDS}
            for line in _objects(menu)
        ]
    }
    for name, place, key in _SUM_FIELDS:
        target[name] = _last(_objects(body.get(place)), key, True)
    return target


def normalize_annotation(col: Column) -> Column:
    """Receipt annotation text -> ``struct<target_json,bad_reason>``.

    Text that is not a JSON object gives the empty receipt.  NULL text and shapes
    that cannot hold a receipt get a reason and no target instead of an error.
    """
    kind = _arrow_type(TARGET_TYPE)

    @F.arrow_udf(TARGET_TYPE)
    def normalize(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            if text is None:
                rows.append({"bad_reason": "no ground truth"})
                continue
            parsed = parse_text(text)
            if parsed is TOO_DEEP:
                rows.append({"bad_reason": "nested too deep to parse"})
                continue
            try:
                rows.append({"target_json": _compact(_receipt_target(parsed))})
            except BadAnnotation as problem:
                rows.append({"bad_reason": str(problem)})
        return pa.array(rows, type=kind)

    return normalize.asNondeterministic()(col)
