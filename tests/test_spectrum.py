"""Spectra from QR factors beside numpy: small values, many tasks, wide and short groups."""

from __future__ import annotations

import numpy as np
import pytest

from fieldmill.operators import spectrum


def _frame(spark, groups: dict, parts: int = 5):
    rows = [(name, row.tolist()) for name, matrix in groups.items() for row in matrix]
    return spark.createDataFrame(rows, "name string, v array<double>").repartition(parts)


def _found(df) -> dict:
    found: dict = {}
    for row in df.orderBy("component").collect():
        found.setdefault(row.name, []).append(row)
    return found


@pytest.mark.parametrize("held", [128 << 20, 1 << 12])
def test_small_values_as_numpy_has_them(spark, held):
    """Values down to 1e-10 of the largest; with little memory the tree has several levels."""
    draw = np.random.default_rng(3)
    left, _ = np.linalg.qr(draw.normal(size=(600, 12)))
    right, _ = np.linalg.qr(draw.normal(size=(12, 12)))
    wanted = np.logspace(0, -10, 12)
    groups = {"graded": left * wanted @ right.T, "plain": draw.normal(size=(90, 4)), "short": draw.normal(size=(2, 7))}
    found = _found(spectrum.singular_spectrum(_frame(spark, groups, 11), "v", "name", held))
    assert set(found) == set(groups)
    for name, matrix in groups.items():
        sigma = np.array([row.sigma for row in found[name]])
        expected = np.zeros(matrix.shape[1])
        values = np.linalg.svd(matrix, compute_uv=False)
        expected[: values.size] = values
        np.testing.assert_allclose(sigma, expected, rtol=1e-4, atol=1e-14)
        assert [row.component for row in found[name]] == list(range(1, matrix.shape[1] + 1))
        share = np.cumsum(expected**2) / (expected**2).sum()
        np.testing.assert_allclose([row.energy for row in found[name]], share, rtol=1e-9)
        assert found[name][0].components_90 == int((share < 0.9).sum()) + 1


def test_wide_vectors(spark):
    draw = np.random.default_rng(4)
    matrix = draw.normal(size=(300, 512))
    found = _found(spectrum.singular_spectrum(_frame(spark, {"wide": matrix}, 3), "v", "name", 1 << 21))
    sigma = [row.sigma for row in found["wide"]]
    np.testing.assert_allclose(sigma[:300], np.linalg.svd(matrix, compute_uv=False), rtol=1e-9)
    assert max(sigma[300:]) == 0


def test_odd_rows(spark):
    rows = [(None, [3.0, 0.0]), (None, [0.0, 4.0]), ("a", None), ("a", []), ("a", [None, 1.0]), ("a", [2.0]), ("z", [0.0])]
    df = spark.createDataFrame(rows, "name string, v array<double>")
    found = _found(spectrum.singular_spectrum(df, "v", "name"))
    assert [round(row.sigma, 9) for row in found[None]] == [4.0, 3.0]
    assert [row.sigma for row in found["a"]] == [2.0] and [row.sigma for row in found["z"]] == [0.0]
    assert spectrum.singular_spectrum(df.where("false"), "v", "name").count() == 0


def test_lengths_must_agree(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0])], "name string, v array<double>")
    for parts in (1, 2):
        with pytest.raises(Exception, match="differ in length"):
            spectrum.singular_spectrum(df.repartition(parts), "v", "name").collect()


def test_no_task_gathers_a_group(spark):
    """Vectors are folded before the first shuffle."""
    df = _frame(spark, {"a": np.ones((4, 2))})
    plan = spectrum.triangular_factors(df.coalesce(2), "v", "name")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
