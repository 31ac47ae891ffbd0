"""Linear regression with absorbed fixed effects."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from absorbia.errors import AbsorbiaError, boundary
from absorbia.functions import dist
from absorbia.plans.config import singleton_mode as policy
from absorbia.plans.factors import Factors, design
from absorbia.plans.specs import Requirements, absorb_terms, names, vce_kind, weight_type
from absorbia.sources.readers import project

from . import moments as M
from .absorb import residualize
from .checks import require, weights_normalised
from .levels import absorbed_dof, drop_spanned, independent
from .results import Result
from .sample import prune


def expand(df: DataFrame, spec, omit=()) -> tuple[DataFrame, list[str]]:
    """Regressors given as columns or factor terms, as numeric columns of df."""
    out: list[str] = []
    for x in [spec] if isinstance(spec, (str, Factors)) else list(spec or []):
        if isinstance(x, Factors):
            made = design(df, x, set(omit))
            df = df.withColumns({n: c for n, c in made.items() if n not in df.columns})
            out += made
        elif x not in omit:
            out.append(x)
    return df, list(dict.fromkeys(out))


def prepare(df: DataFrame, y, groups: dict[str, list[str]], absorb, weights, wtype, clusters, time, panel, singletons=True, outcome=None, counted=None):
    """(sample, terms, term redundancies, effective n, history): checked, weighted and pruned."""
    terms = absorb_terms(absorb)
    need = Requirements.of(outcome=y, **groups, weights=weights, cluster=clusters, time=time, panel=panel, absorb=terms)
    df = project(df, need.columns)
    require(df, need.numeric, need.identifiers)
    if weights:
        df, n = weights_normalised(df, weights, wtype)
        df = df.where("_w > 0")
    else:
        df, n = df.withColumn("_w", F.lit(1.0)), None
    kept_terms, spanned = drop_spanned(df, terms)
    df, history = prune(df, kept_terms, outcome, "_w" if (wtype == "fweight" if counted is None else counted) else None, singletons) if singletons or outcome else (df, [])
    return df, terms, kept_terms, spanned, history


def score_meat(rows: DataFrame, scores, kind: str, clusters, time, panel, kernel, bandwidth, wtype) -> tuple[np.ndarray, dict]:
    """Meat of the score columns under a covariance kind, and what its small-sample factor needs."""
    if kind == "robust":
        weight = 1 / F.col("_w") if wtype == "fweight" else None
        return M.gram(rows, scores, weight=weight), {}
    if kind == "cluster":
        meat, counts = M.multiway_meat(rows, scores, clusters)
        return meat, {"clusters": counts}
    meat, periods, width = M.hac_meat(rows, scores, time, kernel, bandwidth, panel, across=kind == "dkraay")
    return meat, {"periods": periods, "bandwidth": width}


def small_sample(kind: str, n: float, k_total: int, nested: int, info: dict) -> float:
    if kind == "cluster":
        g = min(info["clusters"])
        return (n - 1) / max(n - k_total - nested, 1) * g / (g - 1)
    if kind == "dkraay":
        g = info["periods"]
        return (n - 1) / max(n - k_total, 1) * g / (g - 1)
    return n / max(n - k_total, 1)


def fit_statistics(n: float, k: int, df_a: int, nested: int, rss: float, tss: float, tss_within: float, beta, vcov, slopes: list[int]) -> dict:
    df_fit = n - df_a - nested - k
    out = {"n": n, "k": k, "df_absorbed": df_a, "rss": rss, "tss": tss, "tss_within": tss_within, "mss": tss - rss, "r2": 1 - rss / tss if tss else math.nan, "r2_within": 1 - rss / tss_within if tss_within else math.nan}
    if df_fit > 0:
        out["rmse"] = math.sqrt(rss / df_fit)
        out["r2_adj"] = 1 - rss / df_fit / (tss / (n - 1)) if tss else math.nan
        out["r2_within_adj"] = 1 - rss / df_fit / (tss_within / (df_fit + k)) if tss_within else math.nan
    ll = lambda s: -n / 2 * (1 + math.log(2 * math.pi) + math.log(s / n)) if s > 0 else math.nan
    out |= {"ll": ll(rss), "ll0": ll(tss_within)}
    v, b = vcov[np.ix_(slopes, slopes)], beta[slopes]
    ok = len(slopes) and np.linalg.matrix_rank(v, hermitian=True) == len(slopes)
    out["f"] = float(b @ np.linalg.solve(v, b)) / len(slopes) if ok else math.nan
    return out


def ols(df: DataFrame, y: str, x, absorb=None, **options) -> Result:
    """Weighted least squares of y on x after absorbing fixed effects; for the options see ols_many."""
    return ols_many(df, [y], x, absorb, **options)[0]


@boundary("ols")
def ols_many(df: DataFrame, ys: list[str], x, absorb=None, *, weights: str | None = None, weight_kind: str | None = None, vce: str | None = None, cluster=None, time: str | None = None, panel: str | None = None, kernel: str = "bartlett", bandwidth: float | None = None, dof: str = "pairwise", drop_singletons: bool = True, singleton_mode: str = "stata_compat", collinear: str = "warn", omit=()) -> list[Result]:
    """Least squares of each outcome on the same regressors: one sample, projection and Gram matrix for all.

    x: columns and factor terms; absorb: see absorb_terms. Without fixed effects a constant
    `_cons` is added. collinear: warn (drop and record), drop, or raise.
    """
    policy(singleton_mode)
    clusters, wtype = names(cluster), weight_type(weight_kind, weights)
    kind = vce_kind(vce, clusters, wtype)
    ys = list(dict.fromkeys(ys))
    df, xs = expand(df, x, omit)
    rows, terms, kept_terms, spanned, history = prepare(df, ys, {"regressor": xs}, absorb, weights, wtype, clusters, time, panel, drop_singletons)
    rows, _ = residualize(rows, kept_terms, list(dict.fromkeys([*ys, *xs])), "_w")
    if not terms:
        rows, xs = rows.withColumns({"_cons": F.lit(1.0), "_cons_r": F.lit(1.0)}), [*xs, "_cons"]
    rows = rows.persist()
    w, m = F.col("_w"), len(ys)
    col = lambda c: F.col(f"`{c}_r`")
    raw = [F.col(f"`{c}`").cast("double") for c in [*ys, *xs]]
    totals = rows.agg(F.count(F.lit(1)), F.sum(w), *[F.sum(w * c) for c in raw[:m]], *[F.sum(w * c * c) for c in raw]).first()
    n = totals[1] if wtype == "fweight" else float(totals[0])
    squares = np.array(totals[2 + m :], float)
    g = M.gram(rows, [*map(col, ys), *map(col, xs)], weight=w)
    keep, dropped = independent(g[m:, m:], squares[m:])
    omitted = [(xs[j], why) for j, why in dropped]
    if omitted and collinear == "raise":
        raise AbsorbiaError("identification.collinear", f"collinear: {omitted}", stage="collinearity")
    used = [xs[j] for j in keep]
    at = [m + j for j in keep]
    bread = M.inverse(g[np.ix_(at, at)])
    betas = [bread @ g[at, i] for i in range(m)]
    resids = []
    for y, beta in zip(ys, betas):
        resid = col(y)
        for b, c in zip(beta, used):
            resid = resid - F.lit(float(b)) * col(c)
        resids.append(resid)
    sums = rows.agg(*[F.sum(w * r**2) for r in resids]).first()
    info = absorbed_dof(rows, terms, clusters if kind == "cluster" else (), dof)
    df_a, nested = info["df_absorbed"], int(info["any_nested"])
    k_total = len(used) + df_a
    slopes = [i for i, c in enumerate(used) if c != "_cons"]
    out = []
    for i, (y, beta, resid) in enumerate(zip(ys, betas, resids)):
        rss = float(sums[i] or 0.0)
        fitted = rows.withColumn("_resid", resid)
        df_resid = max(n - k_total, 1)
        if kind == "iid":
            vcov, extra = bread * rss / df_resid, {}
        else:
            scores = [w * F.col("_resid") * col(c) for c in used]
            meat, extra = score_meat(fitted, scores, kind, clusters, time, panel, kernel, bandwidth, wtype)
            vcov = bread @ meat @ bread * small_sample(kind, n, k_total, nested, extra)
            if kind == "cluster" and len(clusters) > 1 and used:
                vcov = M.repair_scaled(vcov, fitted, used)
            if kind == "cluster":
                df_resid = min(df_resid, min(extra["clusters"]) - 1)
            if kind == "dkraay":
                df_resid = min(df_resid, extra["periods"] - 1)
        tss = float(squares[i] - totals[2 + i] ** 2 / totals[1])
        within_tss = float(g[i, i]) if terms else tss
        stats = fit_statistics(n, len(slopes), df_a if terms else 1, nested, rss, tss, within_tss, beta, vcov, slopes)
        if slopes and not math.isnan(stats["f"]):
            stats["f_p"] = dist.f_sf(stats["f"], len(slopes), df_resid)
        stats |= {"levels": info["levels"], "redundant": info["redundant"], "vce": kind, **extra}
        out.append(Result(used, beta, vcov, float(df_resid), stats, omitted + spanned, list(history), fitted, None, "ols", terms, y, rows))
    return out
