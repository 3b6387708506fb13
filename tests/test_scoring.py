from __future__ import annotations

import json
import random

import pytest
import rules
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldmill.functions.receipt import ANNOTATED_SCHEMA
from fieldmill.functions.strict_json import flatten_fields, parse_json
from fieldmill.operators.scoring import (
    compare_models,
    evaluate,
    key_conformance,
    leakage,
    match_fields,
    per_field,
    report,
    score,
    summarize,
    zip_strict,
)
from fieldmill.operators.sweeps import metrics_long


def rows(spark, pairs):
    data = [(i, g, r) for i, (g, r) in enumerate(pairs)]
    return spark.createDataFrame(data, "index long, gold string, raw string")


PERFECT = (
    '{"total":"12.00","menu":[{"name":"Coke","price":"3.0"}]}',
    '{"total":"12","menu":[{"name":"coke","price":"3"}]}',
)


@pytest.mark.parametrize(
    ("gold", "raw", "want"),
    [
        (*PERFECT, (1.0, 1.0, 1.0)),
        ('{"a":"1","b":"2"}', '{"a":"1","b":"99"}', (0.5, 0.5, 0.5)),
        ('{"a":"1"}', None, (0.0, 0.0, 0.0)),
        ("{}", "{}", (1.0, 1.0, 1.0)),
        ("{}", "nothing", (0.0, 0.0, 0.0)),
        ("{}", '{"a":"1"}', (0.0, 0.0, 0.0)),
        ('{"a":"1"}', "{}", (0.0, 0.0, 0.0)),
        ('{"m":[{"n":"x"},{"n":"x"}]}', '{"m":[{"n":"X"}]}', (1.0, 1.0, 1.0)),
    ],
)
def test_field_prf(spark, gold, raw, want):
    row = score(rows(spark, [(gold, raw)])).first()
    assert (row.precision, row.recall, row.field_f1) == want


def test_exact_match_is_object_equality(spark):
    pairs = [
        ('{"a":1,"b":2}', '{"b":2,"a":1.0}'), ('{"a":1}', 'so: {"a":true}'),
        ('{"a":"1200"}', '{"a":"1,200"}'), ('{"a":[1,2]}', '{"a":[2,1]}'),
        ('{"a":NaN}', '{"a":NaN}'), PERFECT,
    ]
    got = score(rows(spark, pairs)).orderBy("index").collect()
    assert [r.exact_match for r in got] == [True, True, False, False, True, False]


def random_pairs(n, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        gold = {k: rng.choice(["1", "2.50", "x", None, 7]) for k in rng.sample("abcd", 3)}
        gold["menu"] = [{"name": rng.choice("uvw"), "p": rng.choice("12")} for _ in range(rng.randint(0, 4))]
        pred = json.loads(json.dumps(gold))
        for _ in range(rng.randint(0, 2)):
            pred[rng.choice("abcdz")] = rng.choice(["1", "9"])
        raw = json.dumps(pred)
        out.append((json.dumps(gold), raw[:-3] if rng.random() < 0.2 else raw))
    return out


def test_scores_sums_and_report_agree_with_the_rules(spark):
    pairs = random_pairs(400)
    scored = score(rows(spark, pairs))
    per_key, total, exact, valid = {}, 0.0, 0, 0
    for (gold, raw), got in zip(pairs, scored.orderBy("index").collect()):
        g, p = json.loads(gold), rules.block(raw)
        assert (got.tp, got.fp, got.fn) == rules.counts(g, p)
        assert got.field_f1 == pytest.approx(rules.f1(g, p))
        assert got.tp + got.fp == (len(rules.flat(p)) if p is not None else 0)
        assert got.tp + got.fn == len(rules.flat(g))
        total, exact, valid = total + rules.f1(g, p), exact + (p == g), valid + (p is not None)
        gs, ps = rules.flat(g), rules.flat(p) if p is not None else set()
        for path, value in gs | ps:
            c = per_key.setdefault(path.split(".")[0].split("[")[0], [0, 0, 0])
            at = 0 if (path, value) in gs & ps else 1 if (path, value) in ps else 2
            c[at] += 1
    summary = summarize(scored).first()
    assert summary.n == 400 and summary.n_exact_match == exact and summary.n_json_valid == valid
    assert summary.field_f1 == pytest.approx(round(total / 400, 4), abs=1e-9)
    assert summary.exact_match == round(exact / 400, 4)
    micro = {r.field: r for r in per_field(scored).collect()}
    assert {k: [r.tp, r.fp, r.fn] for k, r in micro.items()} == per_key
    for key, (tp, fp, fn) in per_key.items():
        p, r = (tp / (tp + fp) if tp + fp else 0.0), (tp / (tp + fn) if tp + fn else 0.0)
        assert micro[key].f1 == round(2 * p * r / (p + r) if p + r else 0.0, 4)
    lines = {r.field: r for r in report(scored).collect()}
    own = lines.pop(None)
    assert (own.n, own.json_valid, own.exact) == (400, valid, exact)
    assert own.millionths == summary.f1_millionths
    assert {k: [r.tp, r.fp, r.fn] for k, r in lines.items()} == per_key


def test_relational_match_equals_in_row_match(spark):
    df = rows(spark, random_pairs(200, 8))
    gold = df.select("index", F.inline(flatten_fields(F.col("gold"))))
    pred = df.select("index", F.inline(parse_json(F.col("raw"), "pairs", block=True)["pairs"]))
    got = match_fields(pred.union(pred), gold).groupBy("index").agg(F.sum("tp"), F.sum("fp"), F.sum("fn"))
    want = score(df).select("index", "tp", "fp", "fn").where("tp + fp + fn > 0")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_partitioning_does_not_change_results(spark):
    df = rows(spark, random_pairs(300, 2))
    want = sorted(map(tuple, per_field(score(df.repartition(1))).collect()))
    assert sorted(map(tuple, per_field(score(df.repartition(16))).collect())) == want


def test_empty_input_and_bad_gold(spark):
    empty = summarize(score(rows(spark, []), schema=ANNOTATED_SCHEMA)).first()
    assert (empty.n, empty.field_f1, empty.json_valid_rate) == (0, 0.0, 0.0)
    scored = score(rows(spark, [("not json", "{}"), ('{"a":1}', '{"a":1}')]))
    assert [r.gold_valid for r in scored.orderBy("index").collect()] == [False, True]
    assert summarize(scored).first().n == 1


def test_zip_strict(spark):
    df = rows(spark, random_pairs(50))
    preds, golds = df.select("index", "raw"), df.select("index", "gold")
    assert zip_strict(preds, golds).count() == 50
    assert summarize(evaluate(preds, golds, limit=10)).first().n == 10
    for left, right in (
        (preds.where("index <> 3"), golds),
        (preds, golds.where("index <> 3")),
        (preds.union(preds.limit(1)), golds),
        (preds, golds.union(golds.limit(1))),
    ):
        with pytest.raises(PySparkException):
            zip_strict(left, right).collect()


def test_key_conformance(spark):
    keys = spark.createDataFrame([(k,) for k in ["total", "sum", "sum", "menu"]], "key string")
    got = sorted(map(tuple, key_conformance(keys, ["menu", "total", "tax"]).collect()))
    assert got == [("never", "tax", 0), ("unknown", "sum", 2)]


def test_compare_models(spark):
    wide = spark.createDataFrame(
        [("baseline", 0.5, 0.5, 0.25, 0.0), ("adapter", 1.0, 0.75, 0.5, 0.5)],
        "model string, json_valid_rate double, schema_valid_rate double, field_f1 double, exact_match double",
    )
    got = {r.metric: r.delta for r in compare_models(metrics_long(wide)).collect()}
    assert got == {"json_valid_rate": 0.5, "schema_valid_rate": 0.25, "field_f1": 0.25, "exact_match": 0.5}


def test_leakage(spark):
    train = spark.createDataFrame([("a",)] * 1000 + [("b",)], "t string")
    held_out = spark.createDataFrame([("a",), ("c",)], "t string")
    got = leakage(train, held_out, "t").collect()
    assert [(r.n_train, r.n_eval) for r in got] == [(1000, 1)]
