"""Leakage on canonical content: what counts as equal, and that the filter loses nothing."""

from __future__ import annotations

import random

import pytest

from fieldmill.operators import leakage
from fieldmill.operators.scoring import leakage as byte_leakage


def _frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "line string")


@pytest.mark.parametrize(
    "a, b, equal",
    [
        ('{"a":1,"b":[2,{"c":3,"d":4}]}', '{"b": [2.0, {"d": 4, "c": 3}], "a": 1e0}', True),
        ('{"a":1}', '{"a":"1"}', False),
        ("[1,2]", "[2,1]", False),
        ('{"a":null}', "{}", False),
        ('"\\u00e9"', '"é"', True),
        ("not json", "not json", True),
        ("not json", "not  json", False),
        ('"x"', "x", False),
        ("{}", '{"a":{}}', False),
        ("", "", True),
        (None, None, False),
        (None, "null", False),
    ],
)
def test_equal_content(spark, a, b, equal):
    found = leakage.canonical_leakage(_frame(spark, [a]), _frame(spark, [b]), "line").collect()
    assert [(r.n_train, r.n_eval) for r in found] == ([(1, 1)] if equal else [])


def test_counts_beside_brute_force(spark, monkeypatch):
    """A tiny filter lets nearly everything through; the answer is the same."""
    draw = random.Random(5)
    train = [draw.randrange(400) for _ in range(900)] + [7] * 300
    held = [draw.randrange(400) * 3 for _ in range(500)]
    left = _frame(spark, [f'{{"k":{k},"z":true}}' for k in train]).repartition(6)
    right = _frame(spark, [f'{{"z": 1, "k": {k}.0}}' for k in held])
    wanted = sorted((train.count(k), held.count(k)) for k in set(train) & set(held))
    assert byte_leakage(left, right, "line").count() == 0
    for blocks in (leakage.BLOCKS, 1):
        monkeypatch.setattr(leakage, "BLOCKS", blocks)
        found = leakage.canonical_leakage(left, right, "line").collect()
        assert sorted((r.n_train, r.n_eval) for r in found) == wanted
        assert len({r.content for r in found}) == len(found)


def test_filter_rules_out_most_and_loses_none(spark):
    held = leakage.canonical_key(_frame(spark, [str(i) for i in range(2000)]), "line")
    other = leakage.canonical_key(_frame(spark, [f"o{i}" for i in range(2000)]), "line")
    blocks = leakage.block_filter(held)
    assert blocks.count() <= leakage.BLOCKS
    assert leakage.maybe_held(held, blocks).count() == 2000
    assert leakage.maybe_held(other, blocks).count() < 20


def test_the_filter_stands_before_the_shuffle(spark):
    keys = leakage.canonical_key(_frame(spark, ["1"]), "line")
    plan = leakage.maybe_held(keys, leakage.block_filter(keys))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(block" in plan
    assert "hashpartitioning(content" not in plan and "Python" in plan


def test_empty_sides(spark):
    some, none = _frame(spark, ["1"]), _frame(spark, ["1"]).where("false")
    assert leakage.canonical_leakage(some, none, "line").count() == 0
    assert leakage.canonical_leakage(none, some, "line").count() == 0
