"""Pruned search for the most similar centroid against the whole matrix."""

import math

import numpy as np
import pytest

from voxframe.functions.core import written
from voxframe.operators import embed as EM
from voxframe.operators import nearest as NN

SCHEMA = "clip_key long, name string, embedding array<double>"


def _same_as_the_matrix(store, **how):
    cos = {}
    for r in EM.cosine_matrix(store, batch_names=64, salts=2).collect():
        cos.setdefault(r.clip_key, {})[r.c_name] = r.cos
    got = {r.clip_key: r for r in NN.nearest_names(store, **how).collect()}
    assert got.keys() == cos.keys()
    for k, row in got.items():
        of = cos[k]
        others = [v for n, v in of.items() if n != row.name]
        assert row.own_cos == pytest.approx(of[row.name], abs=1e-12)
        assert row.other_cos == (pytest.approx(max(others), abs=1e-12) if others else None)
        assert row.pred == max(of, key=lambda n: (round(of[n], 12), n is not None, n or ""))


def _clustered(names: int, clips: int, dim: int = 16) -> list:
    rng = np.random.default_rng(5)
    groups = rng.normal(size=(20, dim))
    at = groups[rng.integers(0, 20, names)] + 0.15 * rng.normal(size=(names, dim))
    return [(i, f"n{i % names:04d}", (at[i % names] + 0.05 * rng.normal(size=dim)).tolist()) for i in range(names * clips)]


def test_equal_to_the_matrix_on_clusters_with_few_products(spark):
    rows = _clustered(200, 4)
    store = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for pivots in (1, 7, 64):
        _same_as_the_matrix(store, pivots=pivots)
    sums, _ = written(EM.centroid_sums(store), "test-sums")
    assert NN.candidates(store, sums, pivots=64).count() < 200 * len(rows) / 10


def test_equal_to_the_matrix_without_any_structure(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f"n{i % 9}", rng.normal(size=8).tolist()) for i in range(90)]
    _same_as_the_matrix(spark.createDataFrame(rows, SCHEMA), pivots=4)


def test_ties_zero_vectors_single_vectors_null_names(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0]), (3, "b", [1.0, 0.0]), (4, "c", [0.0, 0.0]), (5, None, [0.0, 1.0]),
            (6, None, [1.0, 1.0]), (7, "d", [-1.0, -1.0]), (8, "b", [2.0, 0.0])]
    _same_as_the_matrix(spark.createDataFrame(rows, SCHEMA))
    _same_as_the_matrix(spark.createDataFrame(rows, SCHEMA), pivots=1)
    _same_as_the_matrix(spark.createDataFrame(rows[:2], SCHEMA))  # one name: no other
    _same_as_the_matrix(spark.createDataFrame(rows[3:4], SCHEMA))  # no direction at all
    assert NN.nearest_names(spark.createDataFrame([], SCHEMA)).count() == 0


def test_contrast_loss_is_that_of_the_matrix(spark):
    store = spark.createDataFrame(_clustered(12, 3), SCHEMA)
    want = {r.clip_key: r.contrast_loss for r in EM.ge2e_losses(EM.cosine_matrix(store)).collect()}
    got = {r.clip_key: r.contrast_loss for r in NN.contrast_loss(NN.nearest_names(store)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in got)
    with pytest.raises(ValueError, match="positive"):
        NN.contrast_loss(store, w=-1.0)
