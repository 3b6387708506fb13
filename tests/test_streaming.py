from __future__ import annotations

import json

from fieldmill.functions.receipt import ANNOTATED_SCHEMA
from fieldmill.operators.pairs import pairs_from_predictions
from fieldmill.operators.scoring import score, summarize
from fieldmill.sources.samples import parse_prediction_lines
from fieldmill.streaming.scoring import (
    append_to,
    drop_resent,
    publish_versions,
    read_newest,
    stream_eval,
    stream_pairs,
)

SCHEMA = "run_id string, step long, index long, gold string, raw string"


def files(spark, folder, n=3):
    """Rows in several files, so that the stream takes several micro-batches."""
    for part in range(n):
        rows = [
            ("r", 100 * (1 + i % 2), i, json.dumps({"a": str(i), "b": "x"}),
             ["no json", json.dumps({"a": str(i), "b": "x"}), json.dumps({"a": str(i)})][i % 3])
            for i in range(part * 20, part * 20 + 20)
        ]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return (
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder),
        spark.read.parquet(folder),
    )


def test_stream_eval_equals_batch(spark, tmp_path):
    stream, batch = files(spark, str(tmp_path / "in"))
    scores = stream_eval(stream, ANNOTATED_SCHEMA, n_samples=50)
    assert "gen_field_f1" in scores.columns and "per_field" not in scores.columns
    publish_versions(scores, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = read_newest(spark, str(tmp_path / "t")).orderBy("step").collect()
    want = summarize(score(batch.where("index < 50"), schema=ANNOTATED_SCHEMA), "run_id", "step").orderBy("step").collect()
    assert [(r.step, r.n, r.n_exact_match, r.f1_millionths, r.gen_field_f1, r.gen_schema_valid_rate) for r in got] == [
        (r.step, r.n, r.n_exact_match, r.f1_millionths, r.field_f1, r.schema_valid_rate) for r in want
    ]
    assert sum(r.n for r in got) == 50


def test_a_restarted_stream_goes_on(spark, tmp_path):
    folder, place, mark = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")
    stream, _ = files(spark, folder, 1)
    publish_versions(stream_eval(stream), place, mark).awaitTermination()
    stream, _ = files(spark, folder, 2)
    publish_versions(stream_eval(stream), place, mark).awaitTermination()
    assert sum(r.n for r in read_newest(spark, place).collect()) == 60


def test_stream_pairs_equal_batch(spark, tmp_path):
    stream, batch = files(spark, str(tmp_path / "in"))
    append_to(stream_pairs(stream, "validation"), str(tmp_path / "p"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "p"))
    want = pairs_from_predictions(score(batch), "validation")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 40


def test_prediction_lines_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"index": i, "gold": {"a": i}, "raw": "x", "json_valid": False}) for i in range(5)]
    (tmp_path / "in" / "1.jsonl").write_text("\n".join(lines))
    stream = parse_prediction_lines(spark.readStream.text(str(tmp_path / "in")))
    append_to(pairs_from_predictions(stream, "train"), str(tmp_path / "p"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "p")).orderBy("index").collect()
    assert [r.chosen for r in got] == [json.dumps({"a": i}, separators=(",", ":")) for i in range(5)]


def test_resent_rows_count_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = SCHEMA + ", arrived timestamp"
    rows = [("r", 1, i % 3, "{}", "{}") for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "timestamp'2026-01-01 00:00:00' AS arrived")
    df.write.parquet(folder)
    stream = drop_resent(spark.readStream.schema(schema).parquet(folder), "arrived")
    append_to(stream, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3
