"""Neighbours against brute force, and what the synthetic rows are made of."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netprism.operators import smote


def test_leaves_hold_every_row_once():
    x = np.random.default_rng(1).normal(size=(1000, 3))
    parts = smote.leaves(x, np.random.default_rng(2), 64)
    assert sorted(np.concatenate(parts).tolist()) == list(range(1000)) and max(map(len, parts)) <= 64
    same = smote.leaves(np.zeros((500, 2)), np.random.default_rng(2), 64)
    assert max(map(len, same)) <= 64


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "rare" if i % 3 else "common", float(a), float(1000 * b), float(c) if i % 40 else None, 5.0)
            for i, (a, b, c) in enumerate(rng.normal(size=(6000, 3)))]
    rows += [(9000 + i, "rare", 0.5, 0.5, 0.5, 5.0) for i in range(300)]  # copies of one row
    return spark.createDataFrame(rows, "id long, kind string, a double, b double, c double, same double").repartition(6)


def test_recall_of_neighbours(points):
    rows = smote.scaled_minority(points, "kind", "rare", ["a", "b", "c", "same"])
    local = rows.select("__row", "__z").toPandas()
    z = np.stack(local["__z"])
    assert np.allclose(z.mean(axis=0), 0, atol=1e-9) and np.allclose(z.std(axis=0)[:2], 1, atol=1e-9) and (z[:, 3] == 0).all()
    got = {r["__row"]: r["near"] for r in smote.neighbours(rows, 5).collect()}
    assert set(got) == set(local["__row"])
    hits = total = 0
    for i in range(0, len(z), 10):
        d = np.sqrt(((z - z[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        limit = np.sort(d)[4]
        near = got[local["__row"][i]]
        assert len(near) == 5 and len({n["row"] for n in near}) == 5 and local["__row"][i] not in {n["row"] for n in near}
        assert [n["d"] for n in near] == sorted(n["d"] for n in near)
        hits += sum(n["d"] <= limit + 1e-9 for n in near)
        total += 5
    assert hits / total >= 0.9, hits / total


def test_synthetic_rows_lie_between_neighbours(points):
    cols = ["a", "b", "c", "same"]
    out = smote.smote(points, "kind", "rare", cols, "id", copies=2, with_segment=True).collect()
    assert len(out) == 2 * points.where("kind = 'rare'").count()
    for r in out:
        assert r["id"] is None and r["kind"] == "rare" and r["__near"] == 5
        x, y, got = np.array(r["__x"]), np.array(r["__other"]), np.array([r[c] for c in cols])
        way = y - x
        at = (got - x) @ way / (way @ way) if way @ way else 0.0
        assert -1e-9 <= at <= 1 and np.allclose(x + at * way, got, atol=1e-6)


def test_few_rows(points):
    assert smote.smote(points.where("id = 1"), "kind", "rare", ["a"], "id").count() == 0
    assert smote.smote(points.where("id < 0"), "kind", "rare", ["a"], "id").count() == 0
    two = smote.smote(points.where("id in (1, 2)"), "kind", "rare", ["a"], "id", with_segment=True).collect()
    assert len(two) == 2 and all(r["__near"] == 1 for r in two)
    assert points.where(F.col("kind") == "none").count() == 0


def test_tables_are_searched_one_after_another(spark, points):
    """All tables' lists lay on disk together, with their shuffles and the rows as they are in memory."""
    import os

    def size(folder):
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(folder) for f in names)

    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = size(top)
    rows = smote.scaled_minority(points, "kind", "rare", ["a", "b", "c", "same"])
    after_rows = size(top)
    two = smote.neighbours(rows, 5, tables=2)
    after_two = size(top)
    eight = smote.neighbours(rows, 5, tables=8)
    assert size(top) - after_two < 1.3 * (after_two - after_rows)
    assert after_rows - before < 4300 * 60
    a, b = ({r["__row"]: [n["d"] for n in r["near"]] for r in x.collect()} for x in (two, eight))
    assert all(len(b[i]) == 5 and b[i][4] <= a[i][4] for i in a)


def test_nearest_is_a_stable_sort():
    rng = np.random.default_rng(5)
    for x in (rng.normal(size=(90, 5)), rng.integers(0, 3, (90, 4)).astype(float), np.zeros((7, 2)), np.zeros((1, 3))):
        d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
        np.fill_diagonal(d, np.inf)
        want = np.argsort(d, axis=1, kind="stable")[:, :min(5, len(x) - 1)]
        order, square = smote.nearest(x, 5)
        assert (order == want).all() and (square == np.take_along_axis(d, want, axis=1)).all()


def test_lists_of_two_tables_are_merged():
    far = np.array([[1.0, 3.0, 0, 1.0, 2.0, 3.0], [0, 0, 0, 5.0, 0, 0]])
    row = np.array([[7, 8, 0, 7, 4, 2], [0, 0, 0, 3, 0, 0]])
    there = np.array([[1, 1, 0, 1, 1, 1], [0, 0, 0, 1, 0, 0]], bool)
    far, row, there = smote._nearer(far, row, there, 3)
    assert row[0].tolist() == [7, 4, 2] and far[0].tolist() == [1.0, 2.0, 3.0] and there[0].all()
    assert there[1].tolist() == [True, False, False] and row[1, 0] == 3
