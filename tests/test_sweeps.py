from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmill.operators.predict import predict
from fieldmill.operators.sweeps import (
    axis_names,
    best_checkpoint,
    expand_grid,
    expand_runs,
    latest_run,
    rank_runs,
    retain_last,
    sweep_results,
    with_runs,
)
from fieldmill.operators.vectors import energy_spectrum, group_norms, norms_by_class, top_norms
from fieldmill.sources.samples import write_results


def runs(df):
    rows = df.orderBy("run_no").collect()
    assert [r.run_no for r in rows] == list(range(len(rows)))
    return [(r.label, {k: json.loads(v) for k, v in r.overrides.items()}) for r in rows]


def test_grid(spark):
    points = expand_grid(spark, {"a": [1, 2], "b": [10, 20]}).orderBy("combo_no").collect()
    assert [r.combo for r in points] == [{"a": a, "b": b} for a in "12" for b in ("10", "20")]
    assert expand_grid(spark, None).count() == expand_grid(spark, {}).count() == 1
    assert expand_grid(spark, {"a": [], "b": [1]}).count() == 0


def test_runs(spark):
    assert runs(expand_runs(spark)) == [("", {})]
    methods = [{"label": "plain"}, {"label": "weighted", "weights": True}]
    assert runs(expand_runs(spark, None, methods)) == [("plain", {}), ("weighted", {"weights": True})]
    crossed = runs(expand_runs(spark, {"r": [8, 16]}, methods))
    assert crossed[3] == ("weighted", {"r": 16, "weights": True}) and len(crossed) == 4
    assert [label for label, _ in runs(expand_runs(spark, None, [{"x": 1}, {}, {"y": True, "z": "s"}]))] == ["x=1", "base", "y=True+z=s"]


def test_later_layers_win(spark):
    got = runs(expand_runs(spark, {"r": [8]}, [{"r": 4, "k": "v"}, {}], {"r": 1, "s": None}))
    assert [o for _, o in got] == [{"r": 4, "k": "v", "s": None}, {"r": 8, "s": None}]


def test_rows_times_runs(spark):
    got = with_runs(spark.range(100), {"r": [8, 16]}, [{}, {"q": 1}]).groupBy("run_no").count().collect()
    assert sorted(map(tuple, got)) == [(i, 100) for i in range(4)]


def test_results_are_ranked_and_written(spark, tmp_path):
    grid = {"model.r": [8, 16]}
    table = expand_runs(spark, grid, [{"label": "a"}, {"label": "b"}])
    rates = "field_f1 double, exact_match double, json_valid_rate double, schema_valid_rate double"
    metrics = spark.createDataFrame([(0, 0.5, 0.0, 1.0, 1.0, "x"), (1, 0.9, 0.0, 1.0, 1.0, "y"), (2, 0.5, 0.1, 1.0, 1.0, "z")], f"run_no int, {rates}, run_id string")
    results = sweep_results(table, metrics, grid, variants=True)
    assert results.columns == ["run_no", "variant", "r", "field_f1", "exact_match", "json_valid_rate", "schema_valid_rate", "run_id"]
    ranked = rank_runs(results)
    # the fourth run has no metrics: it stays, and comes last
    assert [r.run_id for r in ranked.collect()] == ["y", "x", "z", None]
    write_results(ranked.coalesce(1), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().variant == "a"
    with pytest.raises(ValueError):
        axis_names({"a.r": [1], "b.r": [2]})


def test_checkpoints(spark):
    log = spark.createDataFrame([("a", 100, 0.5), ("a", 200, 0.25), ("a", 300, 0.25), ("b", 100, float("nan")), ("b", 200, 0.9), ("b", 300, None)], "run_id string, step long, eval_loss double")
    assert sorted(map(tuple, best_checkpoint(log).collect())) == [("a", 200, 0.25), ("b", 200, 0.9)]
    assert sorted(map(tuple, best_checkpoint(log, greater_is_better=True).collect())) == [("a", 100, 0.5), ("b", 200, 0.9)]
    kept = retain_last(log, 2).select("run_id", "step").collect()
    assert sorted(map(tuple, kept)) == [("a", 200), ("a", 300), ("b", 200), ("b", 300)]
    flags = spark.createDataFrame([("r1", True), ("r2", True), ("r3", False)], "run_id string, has_adapter boolean")
    assert latest_run(flags).first().run_id == "r2"


def test_norms_and_spectrum(spark):
    rng = np.random.default_rng(4)
    groups = {"l0.attn.ffn": rng.normal(size=(300, 8)), "l1.mlp": rng.normal(size=(5, 8)), "norm": np.ones((1, 8))}
    data = [(name, [float(np.float32(x)) for x in row]) for name, rows in groups.items() for row in rows]
    df = spark.createDataFrame(data, "name string, v array<float>").repartition(7)
    exact = {n: np.float32(r).astype(float) for n, r in groups.items()}
    norms = group_norms(df, "name", "v")
    got = {r.name: r.norm for r in norms.collect()}
    assert got == pytest.approx({n: np.linalg.norm(m) for n, m in exact.items()})
    assert [r.name for r in top_norms(norms, "name", 2).collect()] == ["l0.attn.ffn", "l1.mlp"]
    sums = {r.name_class: r.norm for r in norms_by_class(norms, "name").collect()}
    assert sums == pytest.approx({"attention": got["l0.attn.ffn"], "mlp/experts": got["l1.mlp"], "other": got["norm"]})
    spectrum = energy_spectrum(df, "v", "name").orderBy("name", "component").collect()
    for name, matrix in exact.items():
        mine = [r for r in spectrum if r.name == name]
        sigma = np.zeros(8)
        values = np.linalg.svd(matrix, compute_uv=False)
        sigma[: len(values)] = values
        assert [r.sigma for r in mine] == pytest.approx(list(sigma), abs=1e-5)
        energy = np.cumsum(sigma**2) / np.sum(sigma**2)
        assert [r.energy for r in mine] == pytest.approx(list(energy), abs=1e-9)
        assert {r.components_90 for r in mine} == {int((energy < 0.9).sum()) + 1}


def test_predict(spark):
    def make():
        sizes = []

        def answer(rows):
            sizes.append(len(rows))
            assert len(rows) <= 4
            return [f"{t}!" for t in rows["t"]]

        return answer

    df = spark.range(0, 50, 1, 3).select("id", F.col("id").cast("string").alias("t"))
    got = predict(df, make, batch_size=4).collect()
    assert len(got) == 50 and all(r.raw == f"{r.id}!" for r in got)
    with pytest.raises(Exception, match="answers for"):
        predict(df, lambda: lambda rows: ["x"], batch_size=4).collect()
