"""What the scoring jobs are held against: the rules as a table of cases, and a slow scorer that
is built another way (decimals for numbers, paths by recursion over a document's leaves)."""

from __future__ import annotations

import json
from decimal import ROUND_HALF_EVEN, Decimal

#: Leaf value -> what it is compared as.
LEAVES = {
    "1,200.00": "1200", "12.50": "12.5", "$3.00": "3", "  Coke ": "coke", "2 cokes": "2",
    "2026-01-02": "2026-01-02", "3-": "3-", "1e+20": "120", "": "", "-0": "-0", "item 12": "12",
    "1.2.3": "1.2.3", "0.03125": "0.0312", "TEA": "tea", "--": "--", ".5": "0.5", "12.": "12",
}


def _number(kept: str) -> str | None:
    """Four decimals of the binary value nearest to the digits, or None if they are no number."""
    sign, body = ("-", kept[1:]) if kept[:1] == "-" else ("", kept)
    whole, dot, part = body.partition(".")
    if not (whole + part).isdecimal() or (dot and not (whole or part)):
        return None
    exact = Decimal(float(f"{whole or 0}.{part or 0}"))
    shown = exact.quantize(Decimal("0.0001"), rounding=ROUND_HALF_EVEN)
    return sign + (f"{shown:f}".rstrip("0").rstrip("."))


def leaf(value) -> str:
    text = str(value)
    number = _number("".join(c for c in text if c.isdecimal() or c in ".-"))
    return text.strip().lower() if number is None else number


def flat(document) -> set:
    found, rest = set(), [((), document)]
    while rest:
        steps, node = rest.pop()
        if isinstance(node, (dict, list)):
            inner = node.items() if isinstance(node, dict) else ((None, child) for child in node)
            rest.extend(((*steps, key), child) for key, child in inner)
        else:
            path = ""
            for step in steps:
                path += "[]" if step is None else f".{step}" if path else step
            found.add((path, leaf(node)))
    return found


def block(raw):
    """The object between the first and the last brace."""
    head, tail = (raw or "").find("{"), (raw or "").rfind("}")
    if head < 0 or tail < head:
        return None
    try:
        value = json.loads(raw[head : tail + 1])
    except (ValueError, RecursionError):
        return None
    return value if type(value) is dict else None


def counts(gold, pred) -> tuple:
    wanted, said = flat(gold), set() if pred is None else flat(pred)
    hits = sum(cell in wanted for cell in said)
    return hits, len(said) - hits, len(wanted) - hits


def f1(gold, pred) -> float:
    hits, invented, missed = counts(gold, pred)
    if pred is not None and not (hits or invented or missed):
        return 1.0
    return hits / (hits + (invented + missed) / 2) if hits else 0.0
