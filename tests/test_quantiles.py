"""Exact quantiles whose bracket is narrowed until few rows are left."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import quantiles as Q
from tidemark.session import stage


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    out = [("wide", float(x)) for x in rng.normal(size=4000)] + [("tied", float(x)) for x in rng.integers(0, 3, 3000)]
    out += [("skewed", float(x)) for x in np.exp(rng.normal(0, 4, 2500))] + [("one", 7.0)] + [("same", 5.0)] * 1500
    out += [(None, float(x)) for x in rng.random(900)] + [("wide", None)]
    return stage(spark.createDataFrame(out, "g string, v double").repartition(5), "quantiles")


@pytest.mark.parametrize("left, accuracy", [(4096, 10_000), (50, 10_000), (20, 100), (2, 50)])
@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.8, 0.999, 1.0])
def test_every_bracket_size_gives_the_same(rows, monkeypatch, left, accuracy, q):
    monkeypatch.setattr(Q, "LEFT", left), monkeypatch.setattr(Q, "ACCURACY", accuracy)
    values = {}
    for r in rows.filter(F.col("v").isNotNull()).collect():
        values.setdefault(r.g, []).append(r.v)
    got = {r.g: (r.n, r.x) for r in Q.exact_quantile(rows, ["g"], "v", q, "x").collect()}
    assert got == {g: (len(v), pytest.approx(np.quantile(v, q), rel=1e-12)) for g, v in values.items()}


def test_all_rows_and_no_rows(rows, monkeypatch):
    monkeypatch.setattr(Q, "LEFT", 30)
    every = [r.v for r in rows.filter(F.col("v").isNotNull()).collect()]
    r = Q.exact_quantile(rows, [], "v", 0.8, "x").first()
    assert (r.n, r.x) == (len(every), pytest.approx(np.quantile(every, 0.8)))
    assert Q.exact_quantile(rows.limit(0), ["g"], "v", 0.5, "x").count() == 0
