"""Absorption converges at any scale, or says that it did not."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from absorbia.errors import AbsorbiaError
from absorbia.operators import absorb
from absorbia.plans.specs import absorb_terms


@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(3)
    rows = [(k, i, (i + d) % 3, float(r.standard_normal()), 1.0) for k, (i, d) in enumerate((i, d) for i in range(3) for d in (0, 0, 1))]
    return spark.createDataFrame(rows, "id long, a long, b long, y double, one double").withColumn("small", F.col("y") * 1e-10).persist()


def test_small_scales_converge(panel, monkeypatch):
    terms = absorb_terms(["a", "b"])
    exact, _ = absorb.residualize(panel, terms, ["y"])
    monkeypatch.setattr(absorb, "MAX_CELLS", 3)
    got, _ = absorb.residualize(panel, terms, ["small", "one"], tolerance=1e-3)
    both = exact.select("id", "y_r").join(got.select("id", "small_r", "one_r"), "id")
    assert both.agg(F.max(F.abs(F.col("y_r") - 1e10 * F.col("small_r")))).first()[0] < 1e-2
    assert both.agg(F.max(F.abs("one_r"))).first()[0] < 1e-12


def test_what_does_not_converge_raises(panel):
    terms = absorb_terms(["a", "b"])
    with pytest.raises(AbsorbiaError) as e:
        absorb.alternate(panel, terms, ["y"], sweeps=2)
    assert e.value.code == "solver.not_converged"
    cells = absorb.collect_cells(panel, terms, {"y": F.col("y")}, F.lit(1.0))
    with pytest.raises(AbsorbiaError) as e:
        absorb.solve(cells, most=2)
    assert e.value.code == "solver.not_converged"
