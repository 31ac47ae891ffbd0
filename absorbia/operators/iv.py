"""Linear instrumental variables with absorbed fixed effects."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from absorbia.errors import AbsorbiaError, boundary
from absorbia.functions import dist
from absorbia.plans.config import singleton_mode as policy
from absorbia.plans.specs import names, vce_kind, weight_type

from . import moments as M
from .absorb import residualize
from .levels import absorbed_dof, independent
from .ols import expand, fit_statistics, prepare, score_meat, small_sample
from .results import Result

# Stock-Yogo critical values by level in per cent and number of endogenous regressors.
# Maximal size: from as many instruments as endogenous regressors up to ten.
SIZE = {
    10: {1: [16.38, 19.93, 22.30, 24.58, 26.87, 29.18, 31.50, 33.84, 36.19, 38.54], 2: [7.03, 13.43, 16.87, 19.45, 21.68, 23.72, 25.64, 27.51, 29.32]},
    15: {1: [8.96, 11.59, 12.83, 13.96, 15.09, 16.23, 17.38, 18.54, 19.71, 20.88], 2: [4.58, 8.18, 9.93, 11.22, 12.33, 13.34, 14.31, 15.24, 16.16]},
    20: {1: [6.66, 8.75, 9.54, 10.26, 10.98, 11.72, 12.48, 13.24, 14.01, 14.78], 2: [3.95, 6.40, 7.54, 8.38, 9.10, 9.77, 10.41, 11.03, 11.65]},
    25: {1: [5.53, 7.25, 7.80, 8.31, 8.84, 9.38, 9.93, 10.50, 11.07, 11.65], 2: [3.63, 5.45, 6.28, 6.89, 7.42, 7.91, 8.39, 8.85, 9.31]},
}
# Maximal relative bias: from two instruments more than endogenous regressors up to ten.
BIAS = {
    5: {1: [13.91, 16.85, 18.37, 19.28, 19.86, 20.25, 20.53, 20.74], 2: [11.04, 13.97, 15.72, 16.88, 17.70, 18.30, 18.76], 3: [9.53, 12.20, 13.95, 15.18, 16.10, 16.80]},
    10: {1: [9.08, 10.27, 10.83, 11.12, 11.29, 11.39, 11.46, 11.49], 2: [7.56, 8.78, 9.48, 9.92, 10.22, 10.43, 10.58], 3: [6.61, 7.77, 8.50, 9.01, 9.37, 9.64]},
    20: {1: [6.46, 6.71, 6.77, 6.76, 6.73, 6.69, 6.65, 6.61], 2: [5.57, 5.91, 6.08, 6.16, 6.20, 6.22, 6.23], 3: [4.99, 5.35, 5.56, 5.69, 5.78, 5.83]},
    30: {1: [5.39, 5.34, 5.25, 5.15, 5.07, 4.99, 4.92, 4.86], 2: [4.73, 4.79, 4.78, 4.76, 4.73, 4.69, 4.66], 3: [4.30, 4.40, 4.44, 4.46, 4.46, 4.45]},
}


def critical_values(endogenous: int, excluded: int) -> dict[str, float]:
    """size_10 ... bias_30 for the numbers of endogenous regressors and excluded instruments, where published."""
    out = {}
    for kind, table, spare in (("size", SIZE, 0), ("bias", BIAS, 2)):
        for level, rows in table.items():
            values, at = rows.get(endogenous, []), excluded - endogenous - spare
            if 0 <= at < len(values):
                out[f"{kind}_{level:02d}"] = values[at]
    return out


def least_root(a: np.ndarray, b: np.ndarray) -> float:
    """Smallest eigenvalue of a against positive definite b."""
    low = np.linalg.cholesky(b)
    half = np.linalg.solve(low, np.linalg.solve(low, a).T)
    return float(np.linalg.eigvalsh((half + half.T) / 2).min())


@boundary("iv")
def iv(df: DataFrame, y: str, exog, endog, instruments, absorb=None, *, estimator: str = "2sls", kappa: float | None = None, fuller: float = 0.0, weights: str | None = None, weight_kind: str | None = None, vce: str | None = None, cluster=None, time: str | None = None, panel: str | None = None, kernel: str = "bartlett", bandwidth: float | None = None, dof: str = "pairwise", drop_singletons: bool = True, singleton_mode: str = "stata_compat", on_stage=None) -> Result:
    """2SLS, LIML (with Fuller's correction), k-class, or two-step GMM (gmm2s)."""
    policy(singleton_mode)
    if estimator not in ("2sls", "liml", "kclass", "gmm2s"):
        raise AbsorbiaError("specification.estimator", f"unknown estimator {estimator!r}", stage="specification")
    if estimator == "kclass" and kappa is None:
        raise AbsorbiaError("specification.kappa", "k-class needs kappa", stage="specification")
    clusters, wtype = names(cluster), weight_type(weight_kind, weights)
    kind = vce_kind(vce, clusters, wtype)
    df, c = expand(df, exog)
    e, z = names(endog), names(instruments)
    rows, terms, kept_terms, spanned, history = prepare(df, y, {"regressor": c, "endogenous": e, "instrument": z}, absorb, weights, wtype, clusters, time, panel, drop_singletons)
    rows, _ = residualize(rows, kept_terms, [y, *c, *e, *z], "_w")
    if not terms:
        rows, c = rows.withColumns({"_cons": F.lit(1.0), "_cons_r": F.lit(1.0)}), [*c, "_cons"]
    rows = held = rows.persist()
    w = F.col("_w")
    col = lambda v: F.col(f"`{v}_r`")
    order = [y, *c, *e, *z]
    raw = rows.agg(F.count(F.lit(1)), F.sum(w), F.sum(w * F.col(y)), F.sum(w * F.col(y) ** 2), *[F.sum(w * F.col(f"`{v}`").cast("double") ** 2) for v in order[1:]]).first()
    n = raw[1] if wtype == "fweight" else float(raw[0])
    g = M.gram(rows, [col(v) for v in order], weight=w)
    # controls come first, so that endogenous columns and instruments are judged given them
    keep_x, drop_x = independent(g[1 : 1 + len(c) + len(e), 1 : 1 + len(c) + len(e)], np.array(raw[4 : 4 + len(c) + len(e)], float))
    at_z = [1 + i for i in range(len(c))] + [1 + len(c) + len(e) + i for i in range(len(z))]
    keep_z, drop_z = independent(g[np.ix_(at_z, at_z)], np.array([raw[3 + i] for i in at_z], float))
    xs = [order[1 + i] for i in keep_x]
    omitted = [(order[1 + i], why) for i, why in drop_x] + [(order[at_z[i]], why) for i, why in drop_z if at_z[i] > len(c)]
    used_z = [order[at_z[i]] for i in keep_z]
    ix, iz = [order.index(v) for v in xs], [order.index(v) for v in used_z]
    ie = [order.index(v) for v in xs if v in e]
    excluded = [v for v in used_z if v not in c]
    if not ie or len(iz) < len(ix):
        raise AbsorbiaError("identification.order", "fewer instruments than endogenous regressors", stage="identification")
    zz_inv, zx, zy, xx, xy = M.inverse(g[np.ix_(iz, iz)]), g[np.ix_(iz, ix)], g[iz, 0], g[np.ix_(ix, ix)], g[ix, 0]
    info = absorbed_dof(rows, terms, clusters if kind == "cluster" else (), dof)
    df_a = max(info["df_absorbed"], int(info["any_nested"]))
    k_total = len(xs) + df_a
    pi = zz_inv @ zx
    projected = zx.T @ pi
    if np.linalg.matrix_rank(projected / np.sqrt(np.outer(np.diag(xx), np.diag(xx))), tol=1e-10) < len(ix):
        raise AbsorbiaError("identification.rank", "the instruments do not identify the endogenous regressors", stage="identification")
    k = {"2sls": 1.0, "gmm2s": 1.0, "kclass": kappa}.get(estimator)
    if k is None:
        ic = [order.index(v) for v in xs if v in c]
        both = [0, *ie]
        a = g[np.ix_(both, both)] - (g[np.ix_(both, ic)] @ M.inverse(g[np.ix_(ic, ic)]) @ g[np.ix_(ic, both)] if ic else 0)
        b = g[np.ix_(both, both)] - g[np.ix_(both, iz)] @ zz_inv @ g[np.ix_(iz, both)]
        k = least_root(a, b) - (fuller / (n - len(iz) - df_a) if fuller else 0.0)
    bread = np.linalg.inv((1 - k) * xx + k * projected)
    beta = bread @ ((1 - k) * xy + k * zx.T @ (zz_inv @ zy))

    def residual(b):
        out = col(y)
        for v, value in zip(xs, b):
            out = out - F.lit(float(value)) * col(v)
        return out

    def combined(coefficients):
        """Columns sum_z z * coefficient, one a regressor."""
        out = []
        for j in range(len(xs)):
            t = F.lit(0.0)
            for i, v in enumerate(used_z):
                t = t + F.lit(float(coefficients[i, j])) * col(v)
            out.append(t)
        return out

    meat_of = lambda scores: score_meat(rows, scores, kind, clusters, time, panel, kernel, bandwidth, wtype)
    s_iid = lambda b: float(rows.agg(F.sum(w * residual(b) ** 2)).first()[0]) / n * g[np.ix_(iz, iz)]

    def moment_cov(b):
        return (s_iid(b), {}) if kind == "iid" else meat_of([w * residual(b) * col(v) for v in used_z])

    j_stat = j_p = math.nan
    if estimator == "gmm2s":
        s, extra = moment_cov(beta)
        weight = M.inverse(s)
        vcov = np.linalg.inv(zx.T @ weight @ zx)
        beta = vcov @ zx.T @ weight @ zy
        gap = zy - zx @ beta
        j_stat = float(gap @ weight @ gap)
    rows = rows.withColumn("_resid", residual(beta))
    rss = float(rows.agg(F.sum(w * F.col("_resid") ** 2)).first()[0])
    if on_stage:
        on_stage("estimation", {"beta": beta.tolist(), "names": xs})
    df_resid = max(n - k_total, 1)
    extra: dict = {}
    if kind == "iid":
        if estimator == "gmm2s":
            vcov = vcov * n / df_resid
        elif k in (0.0, 1.0):
            vcov = bread * rss / df_resid
        else:
            hh = (1 - k) ** 2 * xx + (2 * k * (1 - k) + k * k) * projected
            vcov = bread @ hh @ bread * rss / df_resid
    else:
        h = [F.lit(1 - k) * col(v) + F.lit(k) * p for v, p in zip(xs, combined(pi))]
        meat, extra = meat_of([w * F.col("_resid") * v for v in h])
        factor = small_sample(kind, n, k_total, 0, extra)
        vcov = vcov * factor if estimator == "gmm2s" else bread @ meat @ bread * factor
        if kind == "cluster":
            df_resid = min(df_resid, min(extra["clusters"]) - 1)
            vcov = M.repair_scaled(vcov, rows, xs) if len(clusters) > 1 else vcov
        if kind == "dkraay":
            df_resid = min(df_resid, extra["periods"] - 1)
    over = len(iz) - len(ix)
    if over and estimator != "gmm2s":
        if kind == "iid":
            gap = zy - zx @ beta
            j_stat = float(gap @ zz_inv @ gap) / (rss / n)
        else:
            s, _ = moment_cov(beta)
            weight = M.inverse(s)
            b2 = np.linalg.solve(zx.T @ weight @ zx, zx.T @ weight @ zy)
            gap = zy - zx @ b2
            j_stat = float(gap @ weight @ gap)
    if over:
        j_p = dist.chi2_sf(j_stat, over)
    tss = float(raw[3] - raw[2] ** 2 / raw[1])
    slopes = [i for i, v in enumerate(xs) if v != "_cons"]
    stats = fit_statistics(n, len(slopes), df_a if terms else 1, 0, rss, tss, float(g[0, 0]) if terms else tss, beta, vcov, slopes)
    stats |= {"kappa": k, "j": j_stat, "j_df": over, "j_p": j_p, "vce": kind, "levels": info["levels"], **extra}
    endog_used = [v for v in xs if v in e]
    stats["first_stage"] = first_stage(g, order, endog_used, [v for v in xs if v in c], excluded, n, df_a)
    if on_stage:
        on_stage("first_stage", stats["first_stage"])
    stats |= weak_instruments(g, order, endog_used, [v for v in xs if v in c], excluded, n, df_a)
    stats |= kleibergen_paap(rows, g, order, endog_used, [v for v in xs if v in c], excluded, n, df_a, kind, meat_of, w, col)
    if on_stage:
        on_stage("diagnostics", stats)
    return Result(xs, beta, vcov, float(df_resid), stats, omitted + spanned, history, rows, None, f"iv-{estimator}", terms, y, held)


def _partial(g, order, columns, controls):
    """Gram of columns with the controls projected out."""
    i, c = [order.index(v) for v in columns], [order.index(v) for v in controls]
    out = g[np.ix_(i, i)]
    return out - g[np.ix_(i, c)] @ M.inverse(g[np.ix_(c, c)]) @ g[np.ix_(c, i)] if c else out


def first_stage(g, order, endog, controls, excluded, n, df_a) -> dict:
    """Partial R2, F and p, Shea's partial R2, and Sanderson-Windmeijer F, for each endogenous column."""
    out, l = {}, len(excluded)
    a = _partial(g, order, [*endog, *excluded], controls)
    m = len(endog)
    ee, ez, zz = a[:m, :m], a[:m, m:], a[m:, m:]
    fitted = ez @ M.inverse(zz) @ ez.T
    df2 = n - df_a - len(controls) - l
    inv_e, inv_f = np.linalg.inv(ee), np.linalg.inv(fitted)
    for i, v in enumerate(endog):
        r2 = fitted[i, i] / ee[i, i]
        f = r2 / (1 - r2) * df2 / l
        shea = inv_e[i, i] / inv_f[i, i]
        others = [j for j in range(m) if j != i]
        sw = f
        if others:
            d = np.linalg.solve(fitted[np.ix_(others, others)], fitted[others, i])
            t = np.zeros(m)
            t[i], t[others] = 1.0, -d
            explained, total = t @ fitted @ t, t @ ee @ t
            sw = explained / (total - explained) * df2 / (l - m + 1)
        out[v] = {"partial_r2": float(r2), "f": float(f), "f_p": dist.f_sf(f, l, df2), "shea_r2": float(shea), "sw_f": float(sw), "df1": l, "df2": df2}
    return out


def weak_instruments(g, order, endog, controls, excluded, n, df_a) -> dict:
    """Cragg-Donald F and the critical values that go with it."""
    a = _partial(g, order, [*endog, *excluded], controls)
    m, l = len(endog), len(excluded)
    ee, ez, zz = a[:m, :m], a[:m, m:], a[m:, m:]
    fitted = ez @ M.inverse(zz) @ ez.T
    df2 = n - df_a - len(controls) - l
    cd = least_root(fitted, ee - fitted) * df2 / l
    out = {"cragg_donald_f": cd}
    out |= {f"stock_yogo_{name}": value for name, value in critical_values(m, l).items()}
    return out


def kleibergen_paap(rows, g, order, endog, controls, excluded, n, df_a, kind, meat_of, w, col) -> dict:
    """Rank statistics (LM, its p-value and Wald F) under the model's covariance."""
    m, l = len(endog), len(excluded)
    ctrl = [order.index(v) for v in controls]

    def partialled(v):
        t = col(v)
        if ctrl:
            b = M.inverse(g[np.ix_(ctrl, ctrl)]) @ g[ctrl, order.index(v)]
            for name, value in zip(controls, b):
                t = t - F.lit(float(value)) * col(name)
        return t

    a = _partial(g, order, [*endog, *excluded], controls)
    ee, ez, zz = a[:m, :m], a[:m, m:], a[m:, m:]
    pi = M.inverse(zz) @ ez.T  # excluded x endog
    zs = [partialled(v) for v in excluded]
    es = [partialled(v) for v in endog]

    def statistic(resid_cov, unrestricted):
        """Rank test of the scaled reduced form with score covariance from its residuals."""
        fe = np.linalg.cholesky(M.inverse(resid_cov / n))
        theta = np.linalg.cholesky(zz / n).T @ pi @ fe
        resid = [e - sum((F.lit(float(pi[i, j])) * zs[i] for i in range(l)), F.lit(0.0)) if unrestricted else e for j, e in enumerate(es)]
        scores = [w * r * z for r in resid for z in zs]
        if kind == "iid":
            cov = np.kron(resid_cov / n, zz)
        else:
            cov, _ = meat_of(scores)
        half = np.linalg.inv(np.linalg.cholesky(zz / n)) / n
        lift = np.kron(fe.T, half)
        v = lift @ cov @ lift.T
        u, s, vt = np.linalg.svd(theta)
        q = m - 1
        u2, v2 = u[:, q:], vt.T[:, q:]
        lam = (u2.T @ theta @ v2).reshape(-1, order="F")
        lift2 = np.kron(v2.T, u2.T)
        return float(lam @ np.linalg.pinv(lift2 @ v @ lift2.T) @ lam)

    wald = statistic(ee - ez @ M.inverse(zz) @ ez.T, True)
    lm = statistic(ee, False)
    df2 = n - df_a - len(controls) - l
    df = l - m + 1
    return {"kp_lm": lm, "kp_lm_p": dist.chi2_sf(lm, df), "kp_wald": wald, "kp_f": wald / l * df2 / n}
