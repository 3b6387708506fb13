from __future__ import annotations

import json
import random

import pytest
import rules
from pyspark.sql import functions as F

from fieldmill.functions.text import (
    fixed4,
    json_block,
    json_string,
    normalize_value,
    plan_downscale,
    round4,
    strip_blanks,
    strip_thousands,
    top_key,
)

LEAVES = {
    "1,200.00": "1200", "12.50": "12.5", "$3.00": "3", "  Coke ": "coke", "2 cokes": "2",
    "item 12": "12", "2026-01-02": "2026-01-02", "1.2.3": "1.2.3", "3-": "3-", "1e+20": "120",
    "": "", "  ": "", "none": "none", "True": "true", "-0": "-0", "-": "-", "-.": "-.",
    "12.": "12", ".5": "0.5", "-.5": "-0.5", "0.03125": "0.0312", "0.00015": "0.0001",
    "\x1c7\x1f": "7", "٣٤": "34", "12345678901234567890": "12345678901234567168",
}


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_normalize_value_examples(spark):
    rows = column(spark, LEAVES).select("v", normalize_value(F.col("v")).alias("n")).collect()
    assert {r.v: r.n for r in rows} == LEAVES


def test_normalize_value_like_the_rules(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(10_000):
        kind = rng.random()
        if kind < 0.3:
            texts.append(repr(rng.randint(0, 10**9) / 10 ** rng.randint(0, 9)))
        elif kind < 0.5:
            texts.append(repr(rng.random() * 10 ** rng.randint(-6, 25)))
        elif kind < 0.7:
            texts.append(str(rng.randint(0, 2**20) / 2 ** rng.randint(0, 20)))
        else:
            texts.append("".join(rng.choice("0123456789.-$, aBé") for _ in range(rng.randint(0, 12))))
    rows = column(spark, texts).select("v", normalize_value(F.col("v")).alias("n")).collect()
    assert [(r.v, r.n) for r in rows if r.n != rules.leaf(r.v)] == []


def test_rounding_is_that_of_the_exact_value(spark):
    rng = random.Random(1)
    values = [rng.random() for _ in range(2000)] + [i / 32 for i in range(33)]
    values += [i / 20000 for i in range(20001)] + [0.99996, 0.99994, 1e9 / 7, 123456.00005]
    rows = column(spark, values, "double").select(
        "v", round4(F.col("v")).alias("r"), fixed4(F.col("v")).alias("t")
    )
    bad = [r for r in rows.collect() if r.r != round(r.v, 4) or r.t != f"{r.v:.4f}"]
    assert bad == []


@pytest.mark.parametrize(
    ("path", "key"),
    [("menu[].name", "menu"), ("total", "total"), ("a.b[].c", "a"), ("[].x", ""), ("a[].b.c", "a")],
)
def test_top_key(spark, path, key):
    assert column(spark, [path]).select(top_key(F.col("v"))).first()[0] == key


def test_strip(spark):
    row = column(spark, ["  1,200 　\n"]).select(
        strip_blanks(F.col("v")), strip_thousands(F.col("v"))
    )
    assert tuple(row.first()) == ("1,200", "1200")


def test_json_block_is_greedy(spark):
    raws = ['here is {"a": 1} done', "no json here", "{broken json", '{"a":1}\n{"b":2} x', "}{"]
    rows = column(spark, raws).select(json_block(F.col("v"))).collect()
    assert [r[0] for r in rows] == ['{"a": 1}', None, None, '{"a":1}\n{"b":2}', None]


def test_json_string(spark):
    texts = ["plain", 'a"b', "back\\slash", "new\nline", "\x01\x1f", "é😀\u2028\x7f", ""]
    rows = column(spark, texts).select("v", json_string(F.col("v")).alias("j")).collect()
    assert all(json.loads(r.j) == r.v for r in rows)
    assert [r.j for r in rows][5] == '"é😀\u2028\x7f"'


def test_plan_downscale(spark):
    sizes = [(100, 100), (2000, 1000), (1, 4_000_000), (1024, 1024), (1025, 1024)]
    df = spark.createDataFrame(sizes, "w int, h int")
    got = [tuple(r[0]) for r in df.select(plan_downscale(F.col("w"), F.col("h"), 1_048_576)).collect()]

    def want(w, h):
        if w * h <= 1_048_576:
            return w, h
        scale = (1_048_576 / (w * h)) ** 0.5
        return max(1, int(w * scale)), max(1, int(h * scale))

    assert got == [want(*size) for size in sizes]
    free = df.select(plan_downscale(F.col("w"), F.col("h"), None)).collect()
    assert [tuple(r[0]) for r in free] == sizes
