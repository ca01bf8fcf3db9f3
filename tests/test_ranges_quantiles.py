"""Range joins against all pairs, quantiles against sorted values."""

import math
import random

import numpy as np
import pytest

from voxframe.functions.core import range_join
from voxframe.operators import analyze as AN


def _pairs(points, ranges, closed=True):
    return sorted((k, p, n) for k, p in points for j, lo, hi, n in ranges
                  if j is not None and j == k and None not in (p, lo, hi) and lo <= p and (p <= hi if closed else p < hi))


def test_ranges_of_all_lengths_equal_all_pairs(spark):
    rng = random.Random(9)
    ranges = [(rng.choice("ab"), lo, lo + rng.choice([0, 1, 7, 8, 9, 100, 12345, 10 ** 6]), i)
              for i in range(300) for lo in [rng.randrange(-2 * 10 ** 6, 2 * 10 ** 6)]]
    ranges += [("a", 5, 4, 900), (None, 0, 9, 901), ("a", None, 9, 902), ("a", 0, 0, 903), ("b", -10 ** 12, 10 ** 12, 904)]
    points = [(rng.choice("abc"), rng.randrange(-3 * 10 ** 6, 3 * 10 ** 6)) for _ in range(300)] + [("a", 0), ("a", None), (None, 3)]
    points += [("a", lo) for k, lo, _, _ in ranges[:50] if k == "a"] + [("b", hi) for k, _, hi, _ in ranges[:50] if k == "b"]
    ps = spark.createDataFrame(points, "k string, p long")
    rs = spark.createDataFrame(ranges, "k string, lo long, hi long, n long")
    for closed in (True, False):
        got = range_join(ps, rs, "p", "lo", "hi", keys=["k"], inclusive_end=closed)
        assert got.columns == ["k", "p", "lo", "hi", "n"]
        assert sorted((r.k, r.p, r.n) for r in got.collect()) == _pairs(points, ranges, closed)


def test_a_range_costs_a_bounded_number_of_rows(spark):
    rs = spark.createDataFrame([(0, 2 ** 50 + 3), (7, 7), (1, 10 ** 6)], "lo long, hi long")
    ps = spark.createDataFrame([(5,)], "p long")
    plan = range_join(ps, rs, "p", "lo", "hi")
    assert sorted(r.hi for r in plan.collect()) == [10 ** 6, 2 ** 50 + 3]
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()


def test_fractions_in_small_units(spark):
    rng = random.Random(3)
    cuts = sorted([0.0, 1.0, 0.5, 0.5 + 2 ** -50, *(rng.random() ** 9 for _ in range(60))])
    ranges = [("w", lo, hi, i) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
    points = [("w", rng.randrange(2 ** 52) / 2 ** 52) for _ in range(300)] + [("w", 0.5), ("w", 0.5 + 2 ** -51)]
    got = range_join(spark.createDataFrame(points, "k string, u double"), spark.createDataFrame(ranges, "k string, lo double, hi double, n long"),
                     "u", "lo", "hi", keys=["k"], inclusive_end=False, unit=2.0 ** -52)
    assert sorted((r.k, r.u, r.n) for r in got.collect()) == _pairs(points, ranges, closed=False)


def test_quantiles_equal_sorted_values(spark):
    rng = random.Random(1)
    groups = {"counts": [rng.randrange(50) for _ in range(999)], "one": [4.5], "same": [7.0] * 30, None: [-1.0, 2.0],
              "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-20, 21) for _ in range(200)],
              "far": [-1.7e308, 1.7e308, 0.0, 5e-324, 3.0], "close": [1 + i * 2.0 ** -52 for i in range(40)]}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    rows += [("counts", None), ("counts", math.nan), ("counts", math.inf), ("empty", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.quantiles for r in AN.exact_quantiles(df, ["k"], "v", cells=64).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k] == pytest.approx(np.quantile(vs, AN.PERCENTILES).tolist(), rel=1e-12, abs=1e-300), k


def test_describe_takes_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "k string, v long")
    got = {r.k: r for r in AN.describe_groups(df, ["k"], "v").collect()}
    assert (got["a"]["count"], got["a"].p50, got["b"]["count"], got["b"].p50) == (2, 1.5, 0, None)
    assert AN.describe_groups(df.limit(0), ["k"], "v").count() == 0


def test_quantiles_hold_no_value_lists(spark):
    df = spark.range(2000).selectExpr("id % 3 AS k", "id AS v")
    plan = AN.describe_groups(df, ["k"], "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
