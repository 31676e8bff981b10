"""Pairs of a least cosine from a matrix product against those of sums in order."""

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.operators import vectors as V
from loomgraph.plans.steps import y22_fact_groups


@pytest.mark.parametrize("odd", [None, np.nan, np.inf, 1e200])
def test_close(odd, monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 16)), rng.normal(size=(70, 16))
    y[:20], x[5], y[30] = x[:20], 0, 0
    if odd is not None:
        x[9, 3] = odd
    with np.errstate(all="ignore"):
        s = V.cosines(x, y)
        if odd is None:
            monkeypatch.setattr(V, "cosines", None)
        for least in (0.4, s[7, 7], 1.0):
            i, j, found = V.close(x, y, least)
            assert {*zip(i, j, found, strict=True)} == {(a, b, s[a, b]) for a, b in zip(*np.nonzero(s >= least), strict=True)}


def test_matrix():
    some = pa.chunked_array([pa.array([[1.0, 2.0], [3.0, None]]).slice(1), pa.array([[5.0, 6.0]])])
    assert np.array_equal(V.matrix(some), [[3, np.nan], [5, 6]], equal_nan=True)
    with pytest.raises(ValueError):
        V.matrix(pa.chunked_array([pa.array([[1.0], [1.0, 2.0], [1.0, 2.0, 3.0]])]))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_blocks_meet_once(spark, kind, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16)
    monkeypatch.setattr(V, "STEP", 8)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(150, 3)).astype(np.float32).astype(float)
    group = [["none", "x", "y", None][i % 4] if i % 5 else "x" for i in range(150)]
    rows = [(i % 140, group[i], v[i].tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, f"id long, group string, vector array<{kind}>")
    s = V.cosines(v, v)
    meet = lambda i, j, wide: group[i] and group[j] and (group[i] == group[j] or wide and "none" in (group[i], group[j]))
    want = lambda wide: sorted((rows[i][0], rows[j][0], s[i, j]) for i in range(150) for j in range(150) if meet(i, j, wide) and rows[i][0] < rows[j][0] and s[i, j] >= 0.7)
    assert sorted(map(tuple, V.compare(df, df, V.at_least(0.7), "none").collect())) == want(True)
    other = df.select("*")
    assert sorted(map(tuple, V.compare(df, other, V.at_least(0.7), "none").collect())) == want(True)
    assert sorted(map(tuple, V.compare(df, df, V.at_least(0.7)).collect())) == want(False)
    best = {}
    for q, b, score in V.compare(df.where("id < 9"), df, V.nearest(3)).collect():
        best.setdefault(q, []).append((-score, b))
    x = [i for i in range(150) if group[i] == "x"]
    assert sorted(best[0])[:3] == sorted((-s[0, j], rows[j][0]) for j in x if rows[j][0] != 0)[:3] or group[140] == "x"


def test_claims_are_compared_once(spark, sf_dir):
    assert "MapInArrow" not in y22_fact_groups(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
