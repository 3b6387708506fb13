from __future__ import annotations

import json
from collections import Counter

import pytest
import rules
from pyspark.sql import functions as F

from fieldmill.functions.perturb import join_members
from fieldmill.functions.receipt import (
    PRODUCTS,
    SYNTHETIC_SCHEMA,
    VENDORS,
    flatten_struct,
    layout_lines,
    merge_objects,
    minify_json,
    normalize_ground_truth,
    struct_members,
)
from fieldmill.functions.schema import compile_schema, native_schema_valid
from fieldmill.functions.strict_json import normalize_annotation
from fieldmill.operators.scoring import leakage
from fieldmill.registry import get_metric, list_datasets, open_dataset, register_dataset, register_metric
from fieldmill.plans import records
from fieldmill.sources import samples
from fieldmill.sources.samples import generate_receipts, preview, synthetic_splits


def targets(df):
    return {r.seed: json.loads(r.target_json) for r in df.select("seed", "target_json").collect()}


def test_receipts_are_deterministic_and_add_up(spark):
    seeds = spark.range(500).withColumnRenamed("id", "seed")
    rows = targets(generate_receipts(seeds, "seed"))
    again = targets(generate_receipts(seeds.repartition(16), "seed"))
    assert rows == again and rows[7] != rows[8]
    assert targets(generate_receipts(seeds, "seed", seed=1))[7] != rows[7]
    conforms = compile_schema(SYNTHETIC_SCHEMA)
    names, counts, vendors = set(), set(), set()
    for r in rows.values():
        assert conforms(r)
        assert abs(float(r["subtotal"]) + float(r["tax"]) - float(r["total"])) < 0.01
        assert abs(sum(float(i["price"]) for i in r["items"]) - float(r["subtotal"])) < 0.01
        listed = [i["name"] for i in r["items"]]
        assert 2 <= len(listed) == len(set(listed)) <= 6
        names |= set(listed)
        counts |= {(len(listed), i["count"]) for i in r["items"]}
        vendors.add(r["vendor"])
        for i in r["items"]:
            assert 1.5 <= float(i["price"]) / int(i["count"]) <= 25.0
    assert names == set(PRODUCTS) and vendors == set(VENDORS) and len(counts) == 20


def test_splits_are_disjoint(spark):
    rows = synthetic_splits(spark, 8, 4)
    assert {r.split: r.n for r in rows.groupBy("split").agg(F.count("*").alias("n")).collect()} == {
        "train": 8, "validation": 4,
    }
    train, held_out = (rows.where(F.col("split") == s) for s in ("train", "validation"))
    assert leakage(train, held_out, "target_json").count() == 0
    assert synthetic_splits(spark, 0, 0).count() == 0
    assert synthetic_splits(spark).count() == 256 + 64
    with pytest.raises(ValueError):
        synthetic_splits(spark, 1_000_001, 1)


def test_layout(spark):
    seeds = spark.range(20).withColumnRenamed("id", "seed")
    rows = generate_receipts(seeds, "seed")
    lines = {}
    for r in layout_lines(rows, "seed").orderBy("seed", "line_no").collect():
        lines.setdefault(r.seed, []).append(r)
    for seed, target in targets(rows).items():
        page = lines[seed]
        assert len(page) == 8 + 2 * len(target["items"])
        assert page[0].text == target["vendor"] and page[1].text == f"DATE: {target['date']}"
        first = target["items"][0]
        assert page[3].text == f"{first['name'][:18]:<18} x{first['count']}"
        assert page[4].text == f"{first['price']:>28}"
        assert page[-2].text == f"TOTAL{target['total']:>23}"
        assert 18 <= page[0].x <= 40 and 16 <= page[0].y <= 36
        steps = [b.y - a.y for a, b in zip(page, page[1:])]
        assert steps == [28, 22, 22] + [22, 20] * len(target["items"]) + [22, 22, 22, 28]


def test_native_flatten_members_and_schema(spark):
    rows = generate_receipts(spark.range(50).withColumnRenamed("id", "seed"), "seed")
    kind = rows.schema["receipt"].dataType
    got = rows.select(
        "target_json",
        flatten_struct(F.col("receipt"), kind).alias("pairs"),
        join_members(struct_members(F.col("receipt"), kind)).alias("joined"),
        native_schema_valid(F.col("receipt"), "items", "date").alias("ok"),
    )
    for r in got.collect():
        assert {tuple(p) for p in r.pairs} == rules.flat(json.loads(r.target_json))
        assert r.joined == r.target_json and r.ok


def annotation(**body):
    return json.dumps({"gt_parse": body})


EMPTY = {"menu": [], "subtotal": "", "tax": "", "total": ""}
TEA = {"nm": "Tea", "cnt": "1", "price": "1,200 "}
LINE = {"name": "Tea", "count": "1", "price": "1200"}
SUB = {"subtotal_price": "1,200", "tax_price": "100"}
CASES = [
    (annotation(menu=[TEA], sub_total=SUB, total={"total_price": "1,300"}),
     {"menu": [LINE], "subtotal": "1200", "tax": "100", "total": "1300"}),
    (annotation(menu=TEA), {**EMPTY, "menu": [LINE]}),
    (annotation(menu=["x", TEA, 5]), {**EMPTY, "menu": [LINE]}),
    (annotation(total=[{"total_price": "1"}, "x", {"total_price": "2"}]), {**EMPTY, "total": "2"}),
    (annotation(sub_total=[{"subtotal_price": "5"}, {"tax_price": "1"}]),
     {**EMPTY, "subtotal": "5", "tax": "1"}),
    (annotation(menu=[{"nm": "é"}]), {**EMPTY, "menu": [{"name": "é", "count": "", "price": ""}]}),
    (annotation(menu="text"), EMPTY),
    ("{}", EMPTY),
    ("not json", EMPTY),
    ("[1]", EMPTY),
]


def test_normalize_annotation(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = df.select(
        "i",
        normalize_annotation(F.col("t")).alias("strict"),
        minify_json(normalize_ground_truth(F.col("t"))).alias("native"),
    ).orderBy("i")
    for (_, want), r in zip(CASES, got.collect()):
        text = json.dumps(want, ensure_ascii=False, separators=(",", ":"))
        assert (r.strict.target_json, r.strict.bad_reason) == (text, None)
        assert r.native == text


def test_lists_that_hold_more_than_objects(spark):
    groups = [
        [{"subtotal_price": "5"}, "{x"],
        ["{x", {"tax_price": "1,5", "subtotal_price": "2"}],
        [json.dumps({"subtotal_price": "9"}), {"tax_price": "3"}, 4, None, [{"tax_price": "8"}]],
        [{"subtotal_price": "1"}, {"subtotal_price": "2"}, {}],
        {"subtotal_price": "7"},
        [None, {"tax_price": "6"}],
        ["none"],
        [],
    ]
    menus = [["{x", {"nm": "a"}], [{"nm": "b", "cnt": "1,0"}, 3, json.dumps({"nm": "no"})]] * 4
    texts = [annotation(menu=m, sub_total=g) for m, g in zip(menus, groups)]
    # an object that repeats a key: the last one counts
    texts.append('{"gt_parse": {"menu": [], "sub_total": {"tax_price": "1", "tax_price": "2"}}}')
    df = spark.createDataFrame([(at, text) for at, text in enumerate(texts)], "i int, t string")
    rows = df.select(
        "i",
        normalize_annotation(F.col("t"))["target_json"].alias("strict"),
        minify_json(normalize_ground_truth(F.col("t"))).alias("native"),
        F.from_json("t", "gt_parse struct<sub_total:string>")["gt_parse"]["sub_total"].alias("group"),
    ).withColumn("merged", merge_objects(F.col("group")))
    for row in rows.collect():
        assert row.native == row.strict, texts[row.i]
        want = json.loads(row.strict)
        got = row.merged.get("subtotal_price", ""), row.merged.get("tax_price", "")
        assert tuple("".join(v.split(",")) for v in got) == (want["subtotal"], want["tax"])


def test_unusable_annotations_get_a_reason(spark):
    texts = [None, '{"gt_parse":null}', '{"gt_parse":[1]}', annotation(menu=None), annotation(menu=5)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(normalize_annotation(F.col("t")).alias("n")).collect():
        assert r.n.target_json is None and r.n.bad_reason


def test_non_string_leaves_pass_through(spark):
    text = annotation(menu=[{"nm": None, "cnt": 2, "price": 1.5}], total={"total_price": 7})
    row = spark.createDataFrame([(text,)], "t string").select(normalize_annotation(F.col("t"))["target_json"])
    assert json.loads(row.first()[0]) == {
        "menu": [{"name": None, "count": 2, "price": 1.5}], "subtotal": "", "tax": "", "total": 7,
    }


def test_registry(spark):
    splits = open_dataset(spark, "synthetic_invoices", n_train=5, n_eval=3)
    assert {s: df.count() for s, df in splits.items()} == {"train": 5, "validation": 3}
    assert spark.sql("SELECT count(*) FROM synthetic_invoices_train").first()[0] == 5
    shown = preview(splits["train"].unionByName(splits["validation"]), 2).collect()
    assert sorted((r.split, r["index"], r.rows) for r in shown) == [
        ("train", 0, 5), ("train", 1, 5), ("validation", 0, 3), ("validation", 1, 3),
    ]
    with pytest.raises(ValueError):
        register_dataset("synthetic_invoices")(lambda spark: {})
    with pytest.raises(KeyError, match="synthetic_invoices"):
        open_dataset(spark, "unknown")
    assert "cord" in list_datasets()
    register_metric("mine")(len)
    register_metric("mine")(abs)
    assert get_metric("mine") is abs
    one = get_metric("field_prf")(F.lit(1), F.lit(1), F.lit(0))["f1"]
    assert spark.range(1).select(one).first()[0] == pytest.approx(2 / 3)


def test_annotated_dataset_from_files(spark, tmp_path):
    rows = [(i, ("train", "validation")[i % 2], f"img{i}", CASES[0][0]) for i in range(10)]
    df = spark.createDataFrame(rows, "index long, split string, image_ref string, ground_truth string")
    df.withColumn("more", F.lit("x")).write.parquet(str(tmp_path / "a"))
    splits = open_dataset(spark, "cord", path=str(tmp_path / "a"), n_train=5, n_eval=0)
    assert [r["index"] for r in splits["train"].orderBy("index").collect()] == [0, 2, 4, 6, 8]
    assert splits["train"].columns == ["index", "split", "image_ref", "target_json", "bad_reason"]
    assert splits["validation"].count() == 0


def test_split_rows_lose_no_order(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(records, "EVAL_START", 100)
    monkeypatch.setattr(samples, "EVAL_START", 100)
    n_orders, n_eval = (spark.read.parquet(f"{sf_dir}/{n}.parquet").count() for n in ("orders", "customer"))
    assert n_orders > 100
    seeds = [*range(n_orders), *range(100, 100 + n_eval)]
    expected = Counter(("train" if seed < 100 else "validation", seed % 100) for seed in seeds)
    found = records.synthetic_split_rows(spark, sf_dir).collect()
    assert Counter((r["split"], r["index"]) for r in found) == expected
