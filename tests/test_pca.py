"""PCA by tall-skinny QR against numpy, with offsets far from zero, constant columns and missing values."""

import numpy as np
import pytest

from netprism.operators import pca


def frame(spark, rows, parts=7):
    names = ", ".join(f"c{i} double" for i in range(rows.shape[1]))
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], names).repartition(parts)


@pytest.mark.parametrize("standardize", [True, False])
def test_axes_equal_numpy(spark, standardize):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(500, 5)) @ rng.normal(size=(5, 5)) + np.array([1e6, -3, 0, 20, 5])
    got = sorted(pca.axes(frame(spark, rows), [f"c{i}" for i in range(5)], standardize=standardize, fan_in=2).collect())
    matrix = np.corrcoef(rows.T) if standardize else np.cov(rows.T)
    values, vectors = np.linalg.eigh(matrix)
    assert np.allclose([r["variance"] for r in got], values[::-1], rtol=1e-6)
    for r, v in zip(got, vectors.T[::-1], strict=True):
        assert abs(abs(np.dot(r["axis"], v)) - 1) < 1e-6
    cumulative = np.cumsum(values[::-1]) / values.sum()
    assert sum(r["kept"] for r in got) == int(np.searchsorted(cumulative, 0.95, side="right")) + 1


def test_constant_column_missing_values_and_few_rows(spark):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(60, 3))
    rows[:, 1] = 7.1
    clean = pca.axes(frame(spark, rows), ["c0", "c1", "c2"]).collect()
    assert abs(sum(r["variance"] for r in clean) - 2) < 1e-9
    odd = frame(spark, np.vstack([rows, [np.nan, 1, 1], [np.inf, 1, 1]])).union(
        spark.createDataFrame([(None, 1.0, 1.0)], "c0 double, c1 double, c2 double"))
    again = pca.axes(odd, ["c0", "c1", "c2"]).collect()
    assert np.allclose([r["variance"] for r in sorted(clean)], [r["variance"] for r in sorted(again)])
    assert pca.axes(frame(spark, rows[:1], 1), ["c0", "c1", "c2"]).collect() == []
    assert pca.axes(frame(spark, rows).limit(0), ["c0", "c1", "c2"]).collect() == []
    two = pca.axes(frame(spark, rows[:2]), ["c0", "c1", "c2"]).collect()
    assert len(two) == 3 and abs(sorted(two)[0]["share"] - 1) < 1e-9
