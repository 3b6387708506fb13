"""Steps whose cost per task or per row must stay bounded as the tables grow."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from fieldmill.functions import strict_json
from fieldmill.functions.perturb import corrupt_digits
from fieldmill.operators.scoring import key_counts
from fieldmill.plans.base import answers, receipts
from fieldmill.plans.scoring import model_delta
from fieldmill.sources import samples


def test_costly_rows_come_in_tasks_of_bounded_size(spark, sf_dir, monkeypatch):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    monkeypatch.setattr(samples, "ROWS_PER_TASK", 7)
    df = receipts(spark, sf_dir)
    assert df.rdd.getNumPartitions() == -(-rows // 7)
    sizes = df.select("seed").rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == rows and max(sizes) <= 3 * 7


def test_no_drawing_step_is_too_large_to_be_compiled(spark, sf_dir, capsys):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        receipts(spark, sf_dir).select("seed", "receipt", "target_json").explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    # the JVM interprets methods beyond 8,000 bytes
    assert sizes and max(sizes) < 8000


def test_products_are_sorted_by_compiled_code(spark, sf_dir):
    plan = receipts(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "array_sort" not in plan and "regexp_extract_all" not in plan


def test_two_models_share_the_drawing_of_their_receipts(spark, sf_dir):
    plan = model_delta(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_short_numbers_take_no_pattern_substitution(monkeypatch):
    monkeypatch.setattr(strict_json, "_NOT_NUMERIC", None)
    leaf = strict_json._canonical_leaf.__wrapped__
    texts = ["7.50", "0.00", "10", "0", "120.0500", "99999999999.9999"]
    assert [leaf(t) for t in texts] == ["7.5", "0", "10", "0", "120.05", "99999999999.9999"]


def test_changing_digits_does_not_cut_the_text_at_each_one(spark):
    rows = spark.createDataFrame([("a1\U0001d7ce²b3",), ("no digit",), ("7",)], "t string")
    changed = rows.select("t", corrupt_digits(F.col("t"), F.md5("t")).alias("c"))
    for r in changed.collect():
        places = [i for i, (a, b) in enumerate(zip(r.t, r.c, strict=True)) if a != b]
        assert len(places) == min(2, sum(c.isdigit() for c in r.t))
        assert all(r.t[i].isdigit() and r.c[i] in "0123456789" for i in places)
    plan = changed._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "split(" not in plan


def test_fields_are_counted_per_key_without_a_lambda(spark):
    rows = spark.createDataFrame(
        [(["1:a1", "4:b[].x", "3:c.dy"], ["1:a1", "3:c.dz", "1:e2"]), ([], ["1:a1"]), (["1:a1"], [])],
        "gold_fields array<string>, pred_fields array<string>",
    )
    counts = key_counts(rows)
    found = sorted((r.field, r.tp, r.fp, r.fn) for r in counts.collect())
    assert found == [
        ("a", 0, 0, 1), ("a", 0, 1, 0), ("a", 1, 0, 0), ("b", 0, 0, 1), ("c", 0, 0, 1),
        ("c", 0, 1, 0), ("e", 0, 1, 0),
    ]
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "regexp_extract" not in plan


def test_members_are_built_only_for_the_answers_that_need_them(spark, sf_dir):
    plan = answers(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert " AS members#" not in plan


ODD = [
    None, "x", 1.5, [], {}, [1, [" A ", {"b": True}], {"b": []}], {"": {"": "y"}, "k": "1,200.00"},
    {"a.b": "c", "a": {"b": "c"}, "l": [{"n": "2 cokes"}, {"n": None}]}, {"long": "7" * 100},
]


def test_fields_met_before_are_not_made_again(monkeypatch):
    monkeypatch.setattr(strict_json, "_fields", strict_json._Fields())
    for document in ODD:
        made = {f"{len(path)}:{path}{value}" for path, value in strict_json.leaves(document)}
        assert sorted(strict_json._tokens(document)) == sorted(made)
    monkeypatch.setattr(strict_json, "_canonical_leaf", None)
    assert strict_json._tokens({"k": "1,200.00"}) == ["1:k1200"]


def test_fields_kept_are_bounded(monkeypatch):
    kept = strict_json._Fields()
    kept.MOST = 10
    monkeypatch.setattr(strict_json, "_fields", kept)
    for i in range(100):
        text = chr(97 + i % 26) + chr(97 + i // 26)
        assert strict_json._tokens({f"k{i % 7}": text}) == [f"2:k{i % 7}{text}"]
        assert sum(len(texts) for keys in kept.values() for texts in keys.values()) <= 10


def test_json_is_written_without_an_encoder_per_value(monkeypatch):
    expected = [json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in [*ODD, "é\"\n"]]
    monkeypatch.setattr(json, "dumps", None)
    assert [strict_json._compact(v) for v in [*ODD, "é\"\n"]] == expected
