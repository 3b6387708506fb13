from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldmill.functions.perturb import (
    KEY_RENAMES,
    MODES,
    PROSE_PREFIXES,
    corrupt_digits,
    drop_key,
    join_members,
    key_digest,
    rename_key,
    truncate_json,
)
from fieldmill.functions.strict_json import extract_json, parse_json
from fieldmill.operators.batching import dense_index
from fieldmill.operators.pairs import (
    attach_samples,
    first_n_ordered,
    pairs_from_gold,
    pairs_from_predictions,
    to_preference_rows,
)
from fieldmill.operators.scoring import score
from fieldmill.sources.samples import (
    read_pairs,
    read_predictions,
    synthetic_splits,
    write_metrics,
    write_pairs,
    write_predictions,
)

GOLD = '{"vendor":"CAFE","date":"2026-01-02","total":"12.50"}'


def draws(spark, n, text=GOLD):
    rows = spark.range(n).select(
        F.lit("train").alias("split"), F.col("id").alias("index"), F.lit(text).alias("target_json")
    )
    return rows


def with_draws(df):
    return df.withColumn("h", key_digest(0, F.col("split"), F.col("index"))).withColumn(
        "m", parse_json(F.col("target_json"), "members")["members"]
    )


def test_rejected_always_differs_and_all_modes_occur(spark):
    rows = pairs_from_gold(draws(spark, 400), seed=1).collect()
    assert all(r.rejected != r.chosen == GOLD for r in rows)
    modes = [r["mode"] for r in rows]
    assert set(modes) == set(MODES)
    assert all(40 < modes.count(m) < 130 for m in MODES)

    def parses(text):
        try:
            json.loads(text)
        except ValueError:
            return False
        return True

    assert {parses(r.rejected) for r in rows} == {True, False}
    again = pairs_from_gold(draws(spark, 400).repartition(16), seed=1).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert sorted(map(tuple, pairs_from_gold(draws(spark, 400), seed=2).collect())) != sorted(map(tuple, rows))


def test_digits(spark):
    for r in with_draws(draws(spark, 200)).select(corrupt_digits(F.col("target_json"), F.col("h")).alias("t")).collect():
        changed = [(a, b) for a, b in zip(GOLD, r.t) if a != b]
        assert len(r.t) == len(GOLD) and len(changed) == 2
        assert all(a.isdigit() and b.isdigit() for a, b in changed)
    for text, hits in (("a1b", 1), ("none", 0), ("é٣²x", 2), ("𝟘😀7", 2)):
        rows = with_draws(draws(spark, 30, text)).select(corrupt_digits(F.col("target_json"), F.col("h")).alias("t"))
        for r in rows.collect():
            changed = [i for i in range(len(text)) if text[i] != r.t[i]]
            assert len(r.t) == len(text) and len(changed) == hits
            assert all(text[i].isdigit() and r.t[i] in "0123456789" for i in changed)


def test_drop_key(spark):
    rows = with_draws(draws(spark, 100)).select(join_members(drop_key(F.col("m"), F.col("h"))).alias("t"))
    left = {tuple(json.loads(r.t)) for r in rows.collect()}
    assert left == {("date", "total"), ("vendor", "total"), ("vendor", "date")}
    one = with_draws(draws(spark, 3, '{"a":1}')).select(join_members(drop_key(F.col("m"), F.col("h"))).alias("t"))
    assert {r.t for r in one.collect()} == {'{"a":1}'}


def test_rename_key(spark):
    rows = with_draws(draws(spark, 100)).select(join_members(rename_key(F.col("m"), F.col("h"))).alias("t"))
    names = {tuple(json.loads(r.t)) for r in rows.collect()}
    assert names == {("store", "date", "total"), ("vendor", "day", "total"), ("vendor", "date", "sum")}
    both = '{"menu":[1],"x":"y","items":[2]}'
    rows = with_draws(draws(spark, 40, both)).select(join_members(rename_key(F.col("m"), F.col("h"))).alias("t"))
    def rebuilt(chosen):
        return json.dumps({(KEY_RENAMES[k] if k == chosen else k): v for k, v in json.loads(both).items()},
                          separators=(",", ":"))
    assert {r.t for r in rows.collect()} == {rebuilt("menu"), rebuilt("items")}
    none = with_draws(draws(spark, 3, '{"a":1}')).select(join_members(rename_key(F.col("m"), F.col("h"))).alias("t"))
    assert {r.t for r in none.collect()} == {'{"a":1}'}


def test_prose_and_truncate(spark):
    rows = pairs_from_gold(draws(spark, 300)).where("mode = 'prose'")
    got = rows.select("rejected", extract_json(F.col("rejected")).alias("found")).collect()
    assert {r.rejected.removesuffix(GOLD) for r in got} == set(PROSE_PREFIXES)
    assert all(r.found == GOLD for r in got)
    texts = ["", "a", "ab", "abc", "é" * 11, GOLD]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    cut = [r[0] for r in df.select(truncate_json(F.col("t"))).collect()]
    assert cut == [t[: max(2, int(len(t) * 0.7))] for t in texts]


def test_texts_no_mode_can_change(spark):
    rows = pairs_from_gold(draws(spark, 30, "{}")).collect()
    assert all(r["mode"] == "prose" and r.rejected.endswith("{}") for r in rows)


def test_pairs_round_trip(spark, tmp_path):
    samples = synthetic_splits(spark, 6, 3)
    pairs = pairs_from_gold(samples, "train", n=4)
    assert pairs.count() == 4
    place = str(tmp_path / "pairs")
    write_pairs(pairs, place)
    want = pairs.select("split", "index", "chosen", "rejected")
    assert sorted(map(tuple, read_pairs(spark, place).collect())) == sorted(map(tuple, want.collect()))
    assert {r.split for r in pairs_from_gold(samples, "test").collect()} == {"test"}
    assert pairs_from_gold(samples, "test").count() == 3


def test_hard_pairs(spark):
    rows = [
        (0, '{"a":"1"}', '{"a":"1"}', True, 1.0), (1, '{"a":"2"}', '{"a":"9"}', True, 0.0),
        (2, '{"a":"3"}', "not json", False, 0.0), (3, "{}", "x", None, 1.0), (4, "{}", "x", True, None),
    ]
    df = spark.createDataFrame(rows, "index long, gold string, raw string, json_valid boolean, field_f1 double")
    got = sorted(map(tuple, pairs_from_predictions(df, "validation").collect()))
    assert [r[1] for r in got] == [1, 2, 3, 4]
    assert got[0] == ("validation", 1, '{"a":"2"}', '{"a":"9"}')


def test_predictions_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(0, '{"b":"é","a":1}', 'ok {"b":"é","a":1}'), (1, '{"a":"2"}', 'say "no"\n'), (2, '{"a":["1","2","3"]}', '{"a":["1"]}')],
        "index long, gold string, raw string",
    )
    place = str(tmp_path / "p")
    write_predictions(score(df), place)
    lines = sorted((json.loads(r.value) for r in spark.read.text(place).collect()), key=lambda x: x["index"])
    assert lines[0] == {"index": 0, "gold": {"b": "é", "a": 1}, "pred": {"b": "é", "a": 1},
                        "raw": 'ok {"b":"é","a":1}', "json_valid": True, "schema_valid": True, "field_f1": 1.0}
    assert lines[1]["pred"] is None and lines[2]["field_f1"] == 0.5
    got = read_predictions(spark, place).orderBy("index").collect()
    assert [r.gold for r in got] == ['{"b":"é","a":1}', '{"a":"2"}', '{"a":["1","2","3"]}']
    assert [r.raw for r in got] == [r.raw for r in df.orderBy("index").collect()]
    assert [(r.json_valid, r.field_f1) for r in got] == [(True, 1.0), (False, 0.0), (True, 0.5)]


def test_predictions_by_run(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, "{}", "{}"), ("b", 0, "{}", "no")], "run string, index long, gold string, raw string")
    write_predictions(score(df), str(tmp_path / "p"), by=("run",))
    got = read_predictions(spark, str(tmp_path / "p")).where("run = 'b'").collect()
    assert [(r.run, r["index"], r.json_valid) for r in got] == [("b", 0, False)]


def test_prediction_lines_with_gaps(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"index":1,"gold":{"z":1,"a":2},"raw":"x"}\n\n[1]\n{"gold":{}}\n')
    got = read_predictions(spark, str(tmp_path / "p.jsonl")).collect()
    assert [tuple(r) for r in got] == [
        (1, '{"z":1,"a":2}', "x", False, 0.0, None),
        (None, None, None, False, 0.0, "not a JSON object"),
        (None, "{}", None, False, 0.0, "no index"),
    ]


def test_write_metrics_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "n long, field_f1 double")
    write_metrics(df, str(tmp_path / "m"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "m")).collect()] == [{"n": 1, "field_f1": None}]


def test_preference_rows(spark):
    samples = spark.createDataFrame([("train", 0, "a.png"), ("validation", 0, "b.png")], "split string, index long, image_ref string")
    pairs = spark.createDataFrame(
        [("train", 0, "c", "r"), ("validation", 0, "c", "r"), (None, 0, "c", "r"), ("test", 0, "c", "r"), ("train", -1, "c", "r")],
        "split string, index long, chosen string, rejected string",
    )
    rows = to_preference_rows(pairs, samples, "extract").collect()
    assert sorted((r.split, r["index"], r.images[0], r.bad_reason) for r in rows if r.images[0]) == [
        ("train", 0, "a.png", None), ("train", 0, "a.png", None), ("validation", 0, "b.png", None),
    ]
    assert sorted((r.split, r["index"]) for r in rows if r.bad_reason) == [("test", 0), ("train", -1)]
    row = rows[0]
    assert [(p["type"], p["text"]) for p in row.prompt[0].content] == [("image", None), ("text", "extract")]
    assert row.chosen[0].role == "assistant" and row.chosen[0].content[0].text == "c"
    with pytest.raises(PySparkException):
        attach_samples(pairs, samples.union(samples)).collect()


def test_first_n_without_index_and_dense_index(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k"))
    assert [r.k for r in first_n_ordered(df, 5, "k").collect()] == [0, 1, 2, 3, 4]
    rows = dense_index(df.where("k % 3 = 0"), "k").collect()
    assert sorted(r["index"] for r in rows) == list(range(334))
    assert all(r.k == 3 * r["index"] for r in rows)
