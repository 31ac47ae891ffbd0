"""Settings, sample policies, errors, scan plans, bootstraps and slope effects on small data."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from absorbia.errors import AbsorbiaError, boundary
from absorbia.operators.effects import diagnose, recover_slopes
from absorbia.operators.iv import critical_values
from absorbia.operators.levels import dense
from absorbia.operators.ols import ols, ols_many
from absorbia.operators.poisson import ivppml, ppml
from absorbia.operators.resampling import draws_at_once, pairs_bootstrap, wild_bootstrap
from absorbia.operators.results import predict
from absorbia.operators.session import Session
from absorbia.plans.config import Absorption, Config, Inference, Sampling, configured, resolve
from absorbia.plans.specs import fe
from absorbia.sources.planning import bytes_per_row, plan_scan


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    n = 400
    d = pd.DataFrame({"a": rng.integers(0, 8, n), "b": rng.integers(0, 5, n), "x": rng.normal(size=n), "z": rng.normal(size=n)})
    d["y"] = 2 * d.x + d.a + d.b * d.z + rng.normal(size=n)
    d["y2"] = d.x - d.a + rng.normal(size=n)
    return d


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data)


def code_of(f) -> str:
    with pytest.raises(AbsorbiaError) as e:
        f()
    return e.value.code


def test_settings_and_arguments(df):
    config = Config(Sampling(drop_singletons=False), Absorption("none"), Inference(vce="robust"))
    got, plain = configured(ols, config)(df, "y", "x", "a"), ols(df, "y", "x", "a", vce="robust", dof="none", drop_singletons=False)
    assert np.allclose(got.se, plain.se) and got.stats["vce"] == "robust"
    assert resolve(None, {"vce": "iid"}) == {"vce": "iid"}
    assert resolve(config, {"vce": "robust"})["vce"] == "robust"
    assert resolve(Config(), {"dof": "exact"})["dof"] == "exact"  # a default setting gives way
    assert code_of(lambda: resolve(config, {"vce": "iid"})) == "specification.config_conflict"
    assert code_of(lambda: Absorption("some")) == "specification.dof"
    assert code_of(lambda: Sampling(singleton_mode="other")) == "specification.singleton_mode"
    assert code_of(lambda: Inference(bandwidth=0)) == "specification.config"
    assert code_of(lambda: ols(df, "y", "x", singleton_mode="other")) == "specification.singleton_mode"


def test_foreign_errors_get_codes():
    def run(error):
        with boundary("here"):
            raise error

    for error, code in ((np.linalg.LinAlgError("s"), "numerics.singular"), (KeyError("k"), "specification.unknown_name"), (ValueError("v"), "specification.value"), (AbsorbiaError("a.b", "m"), "a.b")):
        assert code_of(lambda e=error: run(e)) == code
    with pytest.raises(RuntimeError):
        run(RuntimeError("other"))


def test_sample_policies(spark):
    # level 3 has one row of frequency 5, level 4 only zeros
    rows = [(g, 1 + i % 3, float(i % 2) + 0.1 * i, float((i * 7) % 5)) for g in (1, 2) for i in range(6)] + [(3, 5, 1.0, 2.0), (4, 1, 1.0, 0.0), (4, 1, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "g int, f int, x double, y double")
    fit = lambda **kw: ppml(df, "y", "x", "g", weights="f", weight_kind="fweight", separation=("fe",), **kw).rows
    left = lambda r: {x["g"] for x in r.select("g").distinct().collect()}
    assert left(fit()) == {1, 2}
    assert left(fit(singleton_mode="unified")) == {1, 2, 3}
    assert left(fit(singleton_mode="unified", drop_singletons=False)) == {1, 2, 3}
    with pytest.warns(UserWarning):
        ivppml(df.where("g < 3"), "y", [], "x", "f", "g", separation=("fe", "relu"))
    assert code_of(lambda: ivppml(df, "y", [], "x", "f", "g", separation=("relu",), singleton_mode="unified")) == "specification.separation"


def test_outcomes_share_a_projection(df):
    many = ols_many(df, ["y", "y2"], ["x", "z"], ["a", "b"], cluster="a")
    for y, r in zip(("y", "y2"), many):
        one = ols(df, y, ["x", "z"], ["a", "b"], cluster="a")
        assert r.outcome == y and np.allclose(r.beta, one.beta) and np.allclose(r.vcov, one.vcov)
        assert r.stats["r2"] == pytest.approx(one.stats["r2"])
    session = Session(df)
    first = session.fit_many_y(["y", "y2"], x=["x"], absorb="a")
    assert session.fit(y="y2", x=["x"], absorb="a") is first[1] and session.hits == 1
    assert session.within(["x"], "a") is session.within(["x"], "a")
    session.close()
    assert all(r.held is None for r in first)


def test_slope_effects_against_dense_least_squares(df, data):
    r = ols(df, "y", "x", ["a", fe("b", slopes="z", intercept=False)], drop_singletons=False)
    m = np.column_stack([data.x, pd.get_dummies(data.a), pd.get_dummies(data.b).to_numpy() * data.z.to_numpy()[:, None]]).astype(float)
    want = np.linalg.lstsq(m, data.y, rcond=None)[0]
    (_, slope, table), = recover_slopes(r)
    got = {x["b"]: x["effect"] for x in table.collect()}
    assert slope == "z" and np.allclose([got[k] for k in sorted(got)], want[-len(got):])
    fitted = predict(r, df, "response").toPandas()
    assert np.allclose(np.sort(fitted.prediction), np.sort(m @ want))
    assert code_of(lambda: predict(r, df.withColumn("b", df.b + 100), "fe").count()) == "prediction.unknown_level"


def test_bootstraps(df, data):
    r = ols(df, "y", "x", "b", cluster="a")
    draws = wild_bootstrap(r, "a", reps=4000)
    plain = r.vcov[0, 0] / r.stats["clusters"][0] * (r.stats["clusters"][0] - 1) / ((r.stats["n"] - 1) / (r.stats["n"] - 1 - r.stats["df_absorbed"]))
    assert draws.shape == (4000, 1) and draws.mean() == pytest.approx(r.beta[0], abs=0.01) and draws.var() == pytest.approx(plain, rel=0.1)
    assert np.array_equal(draws, wild_bootstrap(r, "a", reps=4000))
    pairs = pairs_bootstrap(lambda d: ols(d, "y", "x").beta, df, "a", reps=3)
    assert pairs.shape == (3, 2) and np.ptp(pairs[:, 0]) > 0
    assert draws_at_once(1_000_000, 3, 24_000_000) == 1 and draws_at_once(10, 1, 800) == 10


def test_plans_codes_notes_and_tables(spark, df):
    plan = plan_scan(df, ["x", "a"])
    assert plan.columns == ("x", "a") and plan.bytes_per_row == bytes_per_row(df.select("x", "a")) == 16 and plan.partitions >= 1
    assert plan_scan(df, ["x"], batch_bytes=80_000).rows_per_batch == 10_000
    assert code_of(lambda: plan_scan(df, ["nope"])) == "data.missing_column" and code_of(lambda: plan_scan(df, ["x"], 0)) == "data.plan"
    frame = lambda values: spark.createDataFrame([(v,) for v in values], "c int")
    assert [dense(frame(v), "c") for v in ([0, 1, 1, 2], [0, 2], [1, 2], [0, None], [])] == [True, False, False, False, True]
    r = ols(df.selectExpr("*", "2 * x AS x2"), "y", ["x", "x2"], "a")
    assert r.omission_note().startswith("omitted: x2 (") and ols(df, "y", "x", "a").omission_note() == ""
    assert critical_values(1, 1)["size_10"] == 16.38 and critical_values(2, 2)["size_10"] == 7.03 and critical_values(3, 5)["bias_05"] == 9.53
    assert critical_values(1, 2).keys() == {"size_10", "size_15", "size_20", "size_25"} and critical_values(4, 9) == {} and critical_values(1, 11) == {}
    codes = {f["code"] for f in diagnose(spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 3)], "a int, b int"), [fe("a"), fe("b")])}
    assert codes >= {"effects.nested"}
