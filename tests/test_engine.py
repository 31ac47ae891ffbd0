"""Estimators against dense algebra, and the sources and specifications around them."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from absorbia import reports
from absorbia.errors import AbsorbiaError
from absorbia.functions import dist, kernels
from absorbia.operators import absorb, groups, levels, resampling, sample
from absorbia.operators.effects import recover
from absorbia.operators.iv import iv
from absorbia.operators.ols import ols
from absorbia.operators.poisson import ivppml, ppml, separated_rows
from absorbia.operators.results import predict
from absorbia.operators.session import Session
from absorbia.plans.factors import fv
from absorbia.plans.specs import Requirements, absorb_terms, fe, vce_kind
from absorbia.sources import ResultStore, read, source_fingerprint


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(640)
    n = 400
    a, b = r.integers(0, 17, n), r.integers(0, 7, n)
    x1, x2, z1, z2 = r.standard_normal((4, n))
    e = r.standard_normal(n)
    endog = 0.8 * z1 + 0.4 * z2 + 0.3 * e + 0.2 * x1 + r.standard_normal(n)
    y = x1 - 0.4 * x2 + 0.5 * endog + a / 5 - b / 3 + e
    count = r.poisson(np.exp(0.3 * x1 + a / 20 - b / 10)).astype(float)
    return pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "x1": x1, "x2": x2, "z1": z1, "z2": z2, "endog": endog, "y": y, "count": count, "cl": np.arange(n) % 13, "fw": r.integers(1, 4, n)})


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data).persist()


def dummies(*codes):
    return np.concatenate([(c.to_numpy()[:, None] == np.unique(c)).astype(float) for c in codes], axis=1)


def within(v, d, w=None):
    s = np.sqrt(w)[:, None] if w is not None else 1.0
    return v - d @ np.linalg.lstsq(d * s, v * s, rcond=None)[0]


def test_ols_two_way(df, data):
    d = dummies(data.a, data.b)
    v = within(data[["y", "x1", "x2", "endog"]].to_numpy(), d)
    x, y = v[:, 1:], v[:, 0]
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e, bread = y - x @ beta, np.linalg.inv(x.T @ x)
    got = ols(df, "y", ["x1", "x2", "endog"], ["a", "b"])
    dof = 400 - 3 - (17 + 7 - 1)
    assert np.allclose(got.beta, beta) and np.allclose(got.vcov, bread * (e @ e) / dof) and got.df_resid == dof
    robust = ols(df, "y", ["x1", "x2", "endog"], ["a", "b"], vce="robust")
    assert np.allclose(robust.vcov, bread @ (x.T * e**2 @ x) @ bread * 400 / dof)
    s = np.stack([(x * e[:, None])[data.cl == g].sum(axis=0) for g in range(13)])
    clustered = ols(df, "y", ["x1", "x2", "endog"], ["a", "b"], cluster="cl")
    assert np.allclose(clustered.vcov, bread @ s.T @ s @ bread * 399 / dof * 13 / 12) and clustered.df_resid == 12


def test_weights_and_slopes(df, data, spark):
    w = data.fw.to_numpy().astype(float)
    long = spark.createDataFrame(data.loc[data.index.repeat(data.fw)])
    one = ols(df, "y", ["x1", "x2"], ["a", "b"], weights="fw", weight_kind="fw", vce="robust")
    many = ols(long, "y", ["x1", "x2"], ["a", "b"], vce="robust")
    assert np.allclose(one.beta, many.beta) and np.allclose(one.vcov, many.vcov) and one.stats["n"] == w.sum()
    d = np.concatenate([dummies(data.a), dummies(data.a) * data.z1.to_numpy()[:, None], dummies(data.b)], axis=1)
    v = within(data[["y", "x1"]].to_numpy(), d)
    got = ols(df, "y", "x1", [fe("a", slopes="z1"), "b"], drop_singletons=False)
    assert np.allclose(got.beta, v[:, 1] @ v[:, 0] / (v[:, 1] @ v[:, 1]))


def test_projection_routes_agree(df):
    terms = [fe("a"), fe("b")]
    exact, _ = absorb.residualize(df, terms, ["y"])
    sweeps = absorb.alternate(df, terms, ["y"], tolerance=1e-10)
    both = exact.select("id", F.col("y_r").alias("u")).join(sweeps.select("id", "y_r"), "id")
    assert both.agg(F.max(F.abs(F.col("u") - F.col("y_r")))).first()[0] < 1e-7
    assert absorb.certificate(exact, terms, "y_r") < 1e-9


def test_collinear_columns_are_named(df):
    got = ols(df.withColumn("sum", F.col("x1") + F.col("x2")).withColumn("twice", 2 * F.col("x1")).withColumn("of_a", F.col("a") * 1.0), "y", ["x1", "x2", "sum", "twice", "of_a"], ["a", "b"])
    assert got.omitted == [("sum", "linear_combination"), ("twice", "duplicate_or_scaled"), ("of_a", "absorbed_or_zero")]
    with pytest.raises(AbsorbiaError):
        ols(df.withColumn("twice", 2 * F.col("x1")), "y", ["x1", "twice"], "a", collinear="raise")


def test_iv_estimators(df, data):
    d = dummies(data.a)
    v = within(data[["y", "x1", "endog", "z1", "z2"]].to_numpy(), d)
    y, x, z = v[:, 0], v[:, 1:3], v[:, [1, 3, 4]]
    p = z @ np.linalg.lstsq(z, x, rcond=None)[0]
    beta = np.linalg.solve(p.T @ x, p.T @ y)
    e, a = y - x @ beta, np.linalg.inv(p.T @ p)
    got = iv(df, "y", "x1", "endog", ["z1", "z2"], "a", vce="robust")
    dof = 400 - 2 - 17
    assert np.allclose(got.beta, beta) and np.allclose(got.vcov, a @ (p.T * e**2 @ p) @ a * 400 / dof)
    iid = iv(df, "y", "x1", "endog", ["z1", "z2"], "a")
    g = z.T @ e
    assert math.isclose(iid.stats["j"], g @ np.linalg.solve(z.T @ z, g) / (e @ e / 400), rel_tol=1e-8)
    r = within(v[:, [2, 3, 4]], v[:, [1]])
    f = r[:, 0] @ r[:, 1:] @ np.linalg.solve(r[:, 1:].T @ r[:, 1:], r[:, 1:].T @ r[:, 0])
    want = f / (r[:, 0] @ r[:, 0] - f) * (400 - 17 - 3) / 2
    assert math.isclose(iid.stats["cragg_donald_f"], want, rel_tol=1e-8) and math.isclose(iid.stats["first_stage"]["endog"]["f"], want, rel_tol=1e-8)
    assert math.isclose(iid.stats["kp_f"], want, rel_tol=0.05)
    liml = iv(df, "y", "x1", "endog", ["z1", "z2"], "a", estimator="liml")
    just = iv(df, "y", "x1", "endog", "z1", "a", estimator="liml")
    assert liml.stats["kappa"] >= 1 and abs(just.stats["kappa"] - 1) < 1e-9 and np.allclose(just.beta, iv(df, "y", "x1", "endog", "z1", "a").beta)
    s = z.T * e**2 @ z
    w = np.linalg.inv(s)
    zx, zy = z.T @ x, z.T @ y
    assert np.allclose(iv(df, "y", "x1", "endog", ["z1", "z2"], "a", estimator="gmm2s", vce="robust").beta, np.linalg.solve(zx.T @ w @ zx, zx.T @ w @ zy))
    with pytest.raises(AbsorbiaError):
        iv(df, "y", [], ["endog", "x2"], "z1", "a")


def dense_poisson(y, x, steps=60):
    eta = np.log((y + y.mean()) / 2)
    for _ in range(steps):
        mu = np.exp(eta)
        s = np.sqrt(mu)
        beta = np.linalg.lstsq(x * s[:, None], (eta + (y - mu) / mu) * s, rcond=None)[0]
        eta = x @ beta
    return beta, np.exp(eta)


def test_ppml(df, data):
    y = data["count"].to_numpy()
    x = np.concatenate([data[["x1", "x2"]].to_numpy(), dummies(data.a, data.b)], axis=1)
    beta, mu = dense_poisson(y, x)
    got = ppml(df, "count", ["x1", "x2"], ["a", "b"])
    assert np.allclose(got.beta, beta[:2], atol=1e-7)
    t = within(data[["x1", "x2"]].to_numpy(), x[:, 2:], mu)
    bread = np.linalg.inv(t.T * mu @ t)
    dof = 400 - 2 - 23
    assert np.allclose(got.vcov, bread @ (t.T * (y - mu) ** 2 @ t) @ bread * 400 / dof, rtol=1e-6)
    ll = (y * np.log(mu) - mu - [math.lgamma(v + 1) for v in y]).sum()
    assert math.isclose(got.stats["ll"], ll, rel_tol=1e-8)
    total = predict(got, df, "response").agg(F.sum("prediction")).first()[0]
    assert math.isclose(total, y.sum(), rel_tol=1e-8)
    alone = ppml(df, "count", "x1")
    assert alone.names == ["x1", "_cons"] and np.allclose(alone.beta, dense_poisson(y, np.stack([data.x1, np.ones(400)], axis=1))[0], atol=1e-7)


def test_ivppml_solves_its_moments(df):
    got = ivppml(df, "count", "x1", "endog", ["z1", "z2"], ["a"])
    own = ivppml(df.withColumn("same", F.col("x2")), "count", "x1", "x2", "same", ["a"])
    assert np.allclose(own.beta, ppml(df, "count", ["x1", "x2"], ["a"], separation=("fe",)).beta, atol=1e-7)
    assert got.names == ["x1", "endog"] and np.isfinite(got.se).all()


def test_separation(spark):
    y = [0, 0, 0, 0, 0, 2, 3, 5, 7, 10]
    d = [1, 1, 0, 0, 0, 0, 0, 0, 0, 0]
    frame = spark.createDataFrame([(i, float(a), float(b), 0) for i, (a, b) in enumerate(zip(y, d))], "id int, y double, d double, g int")
    bad, _ = separated_rows(frame, [fe("g")], ["d"], "y")
    assert sorted(r["id"] for r in bad.collect()) == [0, 1]
    primer = spark.createDataFrame([(0.0, 1, 1), (1.0, 1, 1), (0.0, 2, 1), (0.0, 2, 2), (1.0, 2, 2)], "y double, a int, b int")
    assert separated_rows(primer, [fe("a"), fe("b")], [], "y")[0].count() == 1
    with pytest.raises(AbsorbiaError):
        ppml(frame.withColumn("y", F.lit(0.0)), "y", "d", "g")


def test_dof_and_rank(df, data, spark):
    pairs = [(0, 0), (0, 1), (1, 2), (1, 3), (2, 2)]
    t = spark.createDataFrame(pairs, "a int, b int")
    assert levels.component_count(t, ("a",), ("b",)) == 2
    rank = np.linalg.matrix_rank(dummies(*(pd.Series(c) for c in zip(*pairs))))
    assert levels.exact_rank(t, [fe("a"), fe("b")]) == rank
    for method in ("pairwise", "firstpair", "exact"):
        assert levels.absorbed_dof(t, [fe("a"), fe("b")], method=method)["df_absorbed"] == rank
    assert levels.absorbed_dof(df, [fe("a"), fe("b")], ["a"])["df_absorbed"] == 6
    assert levels.drop_spanned(df, [fe("a"), fe("a", "b")])[0] == [fe("a", "b")]


def test_pruning_history(spark):
    t = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (2, 2, 1.0), (3, 3, 0.0), (3, 3, 0.0), (4, 4, 1.0), (4, 4, 2.0)], "a int, b int, y double")
    kept, history = sample.prune(t, [fe("a"), fe("b")])
    assert kept.count() == 4 and sum(n for _, n in history) == 3
    assert sample.prune(t, [fe("a"), fe("b")], outcome="y")[0].count() == 2


def test_effects_and_prediction(df, data):
    got = ols(df, "y", ["x1"], ["a", "b"])
    tables = recover(got, "weighted_mean_zero")
    assert [t.name for t, _ in tables] == ["a", "b"]
    mean = tables[1][1].agg(F.sum(F.col("effect") * F.col("weight"))).first()[0]
    assert abs(mean) < 1e-8
    out = predict(got, df, "response").join(got.rows.select("y", "x1", "_resid"), ["y", "x1"])
    assert out.agg(F.max(F.abs(F.col("prediction") + F.col("_resid") - F.col("y")))).first()[0] < 1e-8
    with pytest.raises(AbsorbiaError):
        predict(got, df.withColumn("a", F.col("a") + 100), "response")
    assert got.wald([{"x1": 1.0}])["statistic"] == pytest.approx(got.table()[0][3] ** 2)
    assert got.linear_combination({"x1": 2.0})["estimate"] == pytest.approx(2 * got.beta[0])


def test_effects_are_normalised_by_component(spark):
    r = np.random.default_rng(3)
    block = np.repeat([0, 1], 60)
    a, b, x = r.integers(0, 4, 120) + 4 * block, r.integers(0, 3, 120) + 3 * block, r.standard_normal(120)
    y = x + a * 0.7 - b * 1.3 + r.standard_normal(120)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "x": x, "y": y}))
    got = ols(df, "y", ["x"], ["a", "b"])
    design = np.column_stack([a[:, None] == np.arange(8), b[:, None] == np.arange(6)]).astype(float)
    solved = np.linalg.lstsq(np.column_stack([x, design]), y, rcond=None)[0]
    fa, fb = solved[1:9], solved[9:]
    for kind, centre in (("canonical", lambda g: fb[g].mean()), ("weighted_mean_zero", lambda g: fb[b[np.isin(b, g)]].mean()), ("reference", lambda g: fb[g[1]])):
        wanted_a, wanted_b = fa.copy(), fb.copy()
        for k in (0, 1):
            g, c = np.arange(3 * k, 3 * k + 3), centre(np.arange(3 * k, 3 * k + 3))
            wanted_b[g] -= c
            wanted_a[4 * k : 4 * k + 4] += c
        (_, ta), (_, tb) = recover(got, kind, references={"b": [1, 4]})
        ta, tb = ta.toPandas().sort_values("a"), tb.toPandas().sort_values("b")
        np.testing.assert_allclose(ta["effect"], wanted_a, atol=1e-7)
        np.testing.assert_allclose(tb["effect"], wanted_b, atol=1e-7)
        assert ta["component"].nunique() == 2 and ta.groupby(ta["a"] // 4)["component"].nunique().max() == 1
    mixed = spark.createDataFrame([(0, 5, 1.0), (0, 1, 1.0)], "a long, b long, x double")
    with pytest.raises(AbsorbiaError, match="prediction.combination"):
        predict(got, mixed, "fe")
    out = {r["b"]: r["prediction"] for r in predict(got, mixed, "fe", unknown="null").collect()}
    assert out[5] is None and out[1] == pytest.approx(fa[0] + fb[1], abs=1e-7)
    with pytest.raises(AbsorbiaError):
        recover(got, "other")


def test_unidentified_components_give_null(spark):
    r = np.random.default_rng(4)
    a = np.arange(80) % 4
    extra = np.where(a < 2, 0, 1) * 10 + r.integers(0, 2, 80)  # groups of a and c move together
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": r.integers(0, 3, 80), "c": extra, "x": r.standard_normal(80), "y": r.standard_normal(80)}))
    got = ols(df, "y", ["x"], ["a", "b", "c"])
    assert all(t.where("effect is not null").isEmpty() for _, t in recover(got, strict=True))
    assert all(t.where("effect is null").isEmpty() for _, t in recover(got))


def test_wild_bootstrap_is_exact_with_few_clusters(df):
    got = ols(df.withColumn("g", F.col("cl") % 6), "y", ["x1", "x2"], "a", cluster="g")
    small = resampling.wild_cluster_test(got, "g", "x2", value=-0.4)
    assert small["exact"] and small["draws"] == 64 and 0 < small["p_value"] <= 1
    assert small["statistic"] == pytest.approx((got.beta[1] + 0.4) / got.se[1] * math.sqrt(399 / (400 - 2 - 17) * 6 / 5), rel=1e-6)
    drawn = resampling.draw_clusters(df, "cl", 1)
    assert drawn.select("_draw").distinct().count() == 13


def test_split_panel_jackknife_and_its_bootstrap(spark):
    r = np.random.default_rng(8)
    rows = pd.DataFrame([(e, i, 10 * e + i, t) for e in range(4) for i in range(4) if e != i for t in range(6)], columns=["exp", "imp", "pair", "year"])
    rows["v"] = r.standard_normal(len(rows)) + rows["pair"] / 10
    df = spark.createDataFrame(rows)

    def fit(frame):
        n, v, vv = frame.agg(F.count("v"), F.avg("v"), F.avg(F.col("v") * F.col("v"))).first()
        if not n:
            raise AbsorbiaError("empty", "no rows")
        return np.array([v, vv - v * v])

    value = lambda g: np.array([g["v"].mean(), g["v"].var(ddof=0)])
    early = rows["year"] <= 2
    unit_half = resampling.random_half(df, ["pair"], 5)
    u = df.select("pair", unit_half("pair").alias("h")).distinct().toPandas().set_index("pair")["h"][rows["pair"]].to_numpy()
    b, t = value(rows), (value(rows[early]) + value(rows[~early])) / 2
    got = resampling.split_panel_jackknife(fit, df, "A", time="year", unit="pair", seed=5)
    np.testing.assert_allclose(got["estimate"], 3 * b - t - (value(rows[u == 0]) + value(rows[u == 1])) / 2)
    half = resampling.random_half(df, ["exp", "imp"], 5)
    h = df.select("exp", half("exp").alias("h")).distinct().toPandas().set_index("exp")["h"]
    e, m = h[rows["exp"]].to_numpy(), h[rows["imp"]].to_numpy()
    assert set(e) == {0, 1}
    quarters = [(e == i) & (m == j) for i in (0, 1) for j in (0, 1)]
    if all(q.any() for q in quarters):
        c, x = np.mean([value(rows[q]) for q in quarters], axis=0), np.mean([value(rows[q & k]) for q in quarters for k in (early, ~early)], axis=0)
        np.testing.assert_allclose(resampling.split_panel_jackknife(fit, df, "B", exporter="exp", importer="imp", seed=5)["estimate"], 2 * b - c)
        np.testing.assert_allclose(resampling.split_panel_jackknife(fit, df, "C", time="year", exporter="exp", importer="imp", seed=5)["estimate"], 4 * b - 2 * c - 2 * t + x)
    boot = resampling.jackknife_bootstrap(fit, df, "A", time="year", unit="pair", reps=4, seed=1)
    assert boot["draws"].shape == (4, 2) and boot["failed"] == 0 and (boot["std_error"] > 0).all() and (boot["ci_low"] <= boot["ci_high"]).all()
    with pytest.raises(AbsorbiaError):
        resampling.split_panel_jackknife(fit, df, "A", time="year", unit="nope")
    with pytest.raises(AbsorbiaError):
        resampling.random_half(df.where("pair = 1"), ["pair"], 0)


def test_group_effects(spark):
    r = np.random.default_rng(5)
    rows, effect = [], r.standard_normal(12)
    for g in range(80):
        members = r.choice(12, 3, replace=False)
        x = float(r.standard_normal())
        rows += [(g, int(i), x, 2 * x + float(effect[members].mean()) + 1e-3 * float(r.standard_normal())) for i in members]
        noise = rows[-1][3]
        rows[-3:] = [(*row[:3], noise) for row in rows[-3:]]
    got = groups.group_ols(spark.createDataFrame(rows, "g int, i int, x double, y double"), "y", ["x"], "g", "i")
    assert got.beta[0] == pytest.approx(2, abs=1e-3) and got.stats["individuals"] == 12


def test_distributions_and_kernels():
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.2281388519649385) and dist.normal_ppf(0.975) == pytest.approx(1.959963984540054)
    assert dist.f_sf(4.102821015, 2, 10) == pytest.approx(0.05, abs=1e-8) and dist.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert dist.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05) and dist.chi2_sf(200, 3) < 1e-40
    assert kernels.weight("nw", 1, 4) == 0.75 and kernels.weight("tru", 5, 4) == 0 and kernels.automatic_bandwidth(100) == 5


def test_specs_and_factors(df):
    assert absorb_terms(fv("i(a)#i(b) + i(a)##c(x1)")) == [fe("a", "b"), fe("a", slopes="x1", intercept=False)]
    assert absorb_terms(["a", ("a", "b"), {"group": "b", "slopes": "x1"}]) == [fe("a"), fe("a", "b"), fe("b", slopes="x1")]
    for bad in ("i(a", "a", "i(a)#", "x(a)", "i(a).b"):
        with pytest.raises(AbsorbiaError):
            fv(bad)
    need = Requirements.of(outcome="y", regressor=["x1"], cluster="a", absorb=["a", "b"])
    assert need.columns == ["y", "x1", "a", "b"] and need.identifiers == ["a", "b"] and need.numeric == ["y", "x1"]
    assert vce_kind(None, [], "pweight") == "robust" and vce_kind(None, ["a"], None) == "cluster"
    got = ols(df, "y", ["x1", fv("i(b)")], "a", omit=("b[3]",))
    assert got.names == ["x1", *(f"b[{i}]" for i in (1, 2, 4, 5, 6))]


def test_sources(spark, df, data, tmp_path):
    data.to_csv(tmp_path / "t.csv", index=False)
    data.astype({"a": "int32", "b": "int32"}).to_stata(tmp_path / "t.dta", write_index=False)
    df.write.parquet(str(tmp_path / "t.parquet"))
    for suffix in ("csv", "dta", "parquet"):
        got = read(spark, str(tmp_path / f"t.{suffix}"), ["y", "a"])
        assert got.columns == ["y", "a"] and got.agg(F.sum("a")).first()[0] == data.a.sum() and got.count() == 400
    assert source_fingerprint(df) == source_fingerprint(df.orderBy(F.desc("id"))) != source_fingerprint(df.limit(399))
    for bad in (lambda: read(spark, "x.xlsx"), lambda: read(spark, df, ["nope"]), lambda: read(spark, "t.csv", usecols=["a"])):
        with pytest.raises(AbsorbiaError):
            bad()


def test_session_keeps_results(spark, df, tmp_path):
    spec = {"y": "y", "x": ["x1"], "absorb": "a"}
    store = ResultStore(spark, f"file://{tmp_path}/store")
    s = Session(df, [spec], store)
    first = s.published(**spec)
    s.fit(**spec)
    assert s.hits == 1 and Session(df, [spec], store).published(**spec)["estimates"] == first["estimates"]


def test_bad_input_raises(spark, df):
    for bad in (df.withColumn("x1", F.lit(float("nan"))), df.withColumn("a", F.lit(None).cast("int")), df.withColumn("x1", F.lit("text"))):
        with pytest.raises(AbsorbiaError):
            ols(bad, "y", "x1", "a")
    with pytest.raises(AbsorbiaError):
        ppml(df.withColumn("count", F.lit(-1.0)), "count", "x1", "a")


def test_reports_hold_no_data(df, tmp_path):
    try:
        ols(df, "y", ["secret_column"], "a")
        raise AssertionError
    except Exception as e:  # noqa: BLE001
        error = e
    got = ols(df, "y", ["x1"], "a")
    payload = reports.error_payload(error, got, "crash", {"coefficient": 1e-3, "secret_column": 1.0})
    text = reports.markdown("Error report", payload)
    assert "secret_column" not in text and "x1" not in text and payload["result"]["n"] == 400 and payload["differences"] == {"coefficient": 1e-3}
    plan = reports.plan_payload(df.groupBy("a").count())
    assert plan["operators"].get("HashAggregate") == 2 and plan["operators"].get("Exchange") == 1 and "plan" not in plan
    assert "HashAggregate" in reports.plan_payload(df.groupBy("a").count(), redact=False)["plan"]
    path = str(tmp_path / "r.md")
    assert reports.main(["error", path]) == 0 and open(path).read().startswith("# Error report")
    assert reports.main(["nope"]) == 2
    with pytest.raises(FileExistsError):
        reports.main(["plan", path])
    with pytest.raises(ValueError):
        reports.error_payload(issue="none")


def test_lags_of_fractional_times(spark):
    from absorbia.operators.moments import hac_meat

    rows = [(i * 0.1, 1.0 + (i % 3)) for i in range(10)] + [(5.35, 2.0)]
    df = spark.createDataFrame(rows, "t double, s double")
    got, periods, _ = hac_meat(df, [F.col("s")], "t", "truncated", 2.0)
    step = min(abs(a[0] - b[0]) for a in rows for b in rows if a != b)
    want = sum(a[1] * b[1] for a in rows for b in rows if any(abs(abs(a[0] - b[0]) / step - lag) < 1e-6 for lag in (0, 1, 2)))
    assert periods == 11 and abs(got[0, 0] - want) < 1e-9


def test_log_factorials(spark):
    import math

    from absorbia.operators.poisson import log_factorial

    df = spark.createDataFrame([(v,) for v in (0.0, 0.5, 1.0, 2.0, 7.3, 50.0, 1e4, 1e9)], "y double")
    for y, v in df.select("y", log_factorial(F.col("y"))).collect():
        assert abs(v - math.lgamma(y + 1)) <= 1e-10 * max(1, abs(v))


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from types import SimpleNamespace

    from absorbia.errors import AbsorbiaError
    from absorbia.sources.scratch import shared_folder

    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    assert shared_folder(session("spark://a:7077", "hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(AbsorbiaError) as e:
        shared_folder(session("spark://a:7077", None))
    assert e.value.code == "storage.shared_folder"


def test_components_on_the_driver_and_in_spark_agree(spark):
    r = np.random.default_rng(9)
    pairs = [(int(a), int(b)) for a, b in zip(r.integers(0, 60, 55), r.integers(0, 60, 55))] + [(100 + i, 100 + j) for i in range(40) for j in (i, i + 1)]
    df = spark.createDataFrame(pairs, "a long, b long")
    assert levels.component_count(df, ("a",), ("b",)) == levels.component_count(df, ("a",), ("b",), most=3)
