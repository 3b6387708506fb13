from __future__ import annotations

import json

from pyspark.sql import functions as F

from fieldmill.functions.receipt import SYNTHETIC_SCHEMA
from fieldmill.jobs import main
from fieldmill.sources.samples import read_pairs, synthetic_splits


def test_evaluate_compare_pairs_and_preview(spark, tmp_path, capsys):
    golds = synthetic_splits(spark, 8, 6).where("split = 'validation'")
    schema = tmp_path / "schema.json"
    schema.write_text(json.dumps(SYNTHETIC_SCHEMA))
    for name, wrong in (("base", 3), ("tuned", 1)):
        raw = F.when(F.col("index") < wrong, "?").otherwise(F.col("target_json"))
        golds.select("index", raw.alias("raw")).write.json(str(tmp_path / f"{name}.jsonl"))
        main(["evaluate", "--n-train", "8", "--n-eval", "6", "--answers", str(tmp_path / f"{name}.jsonl"),
              "--schema", str(schema), "--out", str(tmp_path / name)], spark)
    summary = spark.read.json(str(tmp_path / "base" / "summary")).first()
    assert (summary.n, summary.json_valid_rate, summary.exact_match) == (6, 0.5, 0.5)
    assert spark.read.json(str(tmp_path / "tuned" / "per_field")).count() == 6
    main(["compare", "--baseline", str(tmp_path / "base" / "predictions"), "--adapter",
          str(tmp_path / "tuned" / "predictions"), "--out", str(tmp_path / "delta")], spark)
    delta = {r.metric: round(r.delta, 4) for r in spark.read.json(str(tmp_path / "delta")).collect()}
    assert delta["exact_match"] == 0.3333 and delta["json_valid_rate"] == 0.3333
    main(["pairs", "--from-predictions", str(tmp_path / "base" / "predictions"), "--split", "validation",
          "--out", str(tmp_path / "hard")], spark)
    assert sorted(r["index"] for r in read_pairs(spark, str(tmp_path / "hard")).collect()) == [0, 1, 2]
    main(["pairs", "--n-train", "8", "--n", "5", "--out", str(tmp_path / "gold")], spark)
    assert read_pairs(spark, str(tmp_path / "gold")).count() == 5
    main(["preview", "--n-train", "2", "--n-eval", "1"], spark)
    assert "validation" in capsys.readouterr().out


def test_preference_and_encode_put_bad_rows_aside(spark, tmp_path):
    samples = spark.createDataFrame(
        [("train", 0, "a.png"), ("train", 1, "b.png")], "split string, index long, image_ref string"
    )
    samples.write.parquet(str(tmp_path / "samples"))
    pairs = [{"split": "train", "index": i, "chosen": "{}", "rejected": "x"} for i in (0, 1, 7)]
    (tmp_path / "pairs.jsonl").write_text("\n".join(map(json.dumps, pairs)))
    main(["preference", "--pairs", str(tmp_path / "pairs.jsonl"), "--samples", str(tmp_path / "samples"),
          "--instruction", "extract", "--out", str(tmp_path / "rows")], spark)
    rows = spark.read.parquet(str(tmp_path / "rows")).orderBy("index").collect()
    assert [(r["index"], r.images) for r in rows] == [(0, ["a.png"]), (1, ["b.png"])]
    bad = spark.read.json(str(tmp_path / "rows_quarantine")).collect()
    assert [(r["index"], r.bad_reason) for r in bad] == [(7, "no such sample")]

    notes = [(0, "train", "a", '{"gt_parse":{"menu":[]}}'), (3, "train", "b", None)]
    spark.createDataFrame(
        notes, "index long, split string, image_ref string, ground_truth string"
    ).write.parquet(str(tmp_path / "notes"))
    main(["encode", "--dataset", "cord", "--path", str(tmp_path / "notes"), "--instruction", "extract",
          "--out", str(tmp_path / "tokens")], spark)
    row = spark.read.parquet(str(tmp_path / "tokens")).collect()
    assert len(row) == 1 and len(row[0].input_ids) == len(row[0].labels) > row[0].prompt_len
    bad = spark.read.json(str(tmp_path / "tokens_quarantine")).collect()
    assert [(r["index"], r.bad_reason) for r in bad] == [(3, "no ground truth")]


def test_sweep(spark, tmp_path):
    spec = {"grid": {"model.rank": [8, 16]}, "fixed": {"steps": 5}}
    (tmp_path / "spec.json").write_text(json.dumps(spec))
    for run, raw in enumerate(['{"a":"2"}', '{"a":"1"}']):
        folder = tmp_path / "answers" / f"run_no={run}"
        folder.mkdir(parents=True)
        (folder / "p.jsonl").write_text(json.dumps({"index": 0, "gold": {"a": "1"}, "raw": raw}))
    main(["sweep", "--spec", str(tmp_path / "spec.json"), "--answers", str(tmp_path / "answers"),
          "--out", str(tmp_path / "results")], spark)
    rows = spark.read.option("header", True).csv(str(tmp_path / "results")).collect()
    assert [(r["rank"], float(r.field_f1)) for r in rows] == [("16", 1.0), ("8", 0.0)]
