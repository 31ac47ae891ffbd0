"""Results of estimators and tests on them."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from absorbia.errors import AbsorbiaError
from absorbia.functions import dist


@dataclass
class Result:
    """Coefficients, their covariance and fit statistics; rows stay in Spark.

    df_resid is infinite where inference is normal. `rows` holds the estimation sample with
    `_resid` and `_xb`; `solution` the level effects of outcome and regressors, if solved.
    """

    names: list[str]
    beta: np.ndarray
    vcov: np.ndarray
    df_resid: float
    stats: dict = field(default_factory=dict)
    omitted: list[tuple[str, str]] = field(default_factory=list)
    history: list[tuple[str, int]] = field(default_factory=list)
    rows: DataFrame | None = None
    solution: object = None
    model: str = ""
    terms: list = field(default_factory=list)
    outcome: str = ""
    held: DataFrame | None = None

    def release(self) -> None:
        """Give back the memory of the kept estimation rows; they are made again where they are needed."""
        if self.held is not None:
            self.held.unpersist()
            self.held = None

    def omission_note(self, most: int = 8) -> str:
        """One line that names the omitted columns, the first `most` of them, and why."""
        named = ", ".join(f"{name} ({why})" for name, why in self.omitted[:most])
        more = len(self.omitted) - most
        return f"omitted: {named}" + (f" and {more} more" if more > 0 else "") if self.omitted else ""

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.vcov), 0))

    def table(self, level: float = 0.95) -> list[tuple]:
        """(term, estimate, std_error, statistic, p_value, low, high, stars) a coefficient."""
        t = dist.t_ppf(0.5 + level / 2, self.df_resid)
        out = []
        for name, b, s in zip(self.names, self.beta, self.se):
            stat = b / s if s > 0 else math.nan
            p = dist.t_two_sided(stat, self.df_resid)
            stars = "".join("*" for cut in (0.1, 0.05, 0.01) if p < cut)
            out.append((name, float(b), float(s), float(stat), float(p), float(b - t * s), float(b + t * s), stars))
        return out

    def coef_table(self, spark: SparkSession, level: float = 0.95) -> DataFrame:
        return spark.createDataFrame(self.table(level), "term string, estimate double, std_error double, statistic double, p_value double, ci_low double, ci_high double, stars string")

    def linear_combination(self, weights: dict[str, float]) -> dict:
        """Estimate and test of a weighted sum of coefficients."""
        a = np.array([weights.get(n, 0.0) for n in self.names])
        if unknown := set(weights) - set(self.names):
            raise AbsorbiaError("postestimation.unknown_term", f"no coefficient {sorted(unknown)}", stage="postestimation")
        b, s = float(a @ self.beta), float(np.sqrt(max(a @ self.vcov @ a, 0)))
        stat = b / s if s else math.nan
        return {"estimate": b, "std_error": s, "statistic": stat, "p_value": dist.t_two_sided(stat, self.df_resid)}

    def wald(self, restrictions: list[dict[str, float]], values: list[float] | None = None) -> dict:
        """F test (chi-squared where inference is normal) of linear restrictions, of reduced rank if they overlap."""
        r = np.array([[w.get(n, 0.0) for n in self.names] for w in restrictions])
        q = np.zeros(len(r)) if values is None else np.array(values, float)
        size = np.linalg.norm(r, axis=1)
        r, q = r / size[:, None], q / size
        v, gap = r @ self.vcov @ r.T, r @ self.beta - q
        lam, vec = np.linalg.eigh(v)
        keep = lam > 64 * np.finfo(float).eps * len(lam) * max(lam.max(initial=0), 0)
        if not keep.any() or np.abs(vec[:, ~keep].T @ gap).max(initial=0) > 1e-8 * max(1.0, np.abs(gap).max(initial=0)):
            raise AbsorbiaError("postestimation.untestable", "a restriction has no sampling variance", stage="postestimation")
        chi2, rank = float(((vec[:, keep].T @ gap) ** 2 / lam[keep]).sum()), int(keep.sum())
        if math.isinf(self.df_resid):
            return {"statistic": chi2, "df": rank, "df_resid": math.inf, "p_value": dist.chi2_sf(chi2, rank)}
        return {"statistic": chi2 / rank, "df": rank, "df_resid": self.df_resid, "p_value": dist.f_sf(chi2 / rank, rank, self.df_resid)}

    def publication(self) -> dict:
        """Plain values for tables and for keeping."""
        return {"model": self.model, "terms": self.names, "estimates": self.beta.tolist(), "std_errors": self.se.tolist(), "vcov": self.vcov.tolist(), "df_resid": self.df_resid, "stats": {k: v for k, v in self.stats.items() if isinstance(v, (int, float, str))}, "omitted": self.omitted, "fixed_effects": [t.name for t in self.terms]}


def predict(result: Result, df: DataFrame, kind: str = "xb", unknown: str = "raise") -> DataFrame:
    """df with `prediction`: xb, fe (sum of effects), response (both, exponentiated for Poisson) or stdp.

    Levels that were not in the sample, and levels of different components together (their sum is
    not identified), raise, or give null with unknown="null".
    """
    from .effects import recover, recover_slopes, solution_of

    names = [n for n in result.names if n != "_cons"]
    b = dict(zip(result.names, result.beta.tolist()))
    xb = F.lit(b.get("_cons", 0.0))
    for n in names:
        xb = xb + F.lit(b[n]) * F.col(n).cast("double")
    if kind == "xb":
        return df.withColumn("prediction", xb)
    if kind == "stdp":
        cols = [F.lit(1.0) if n == "_cons" else F.col(n).cast("double") for n in result.names]
        total = F.lit(0.0)
        for i, x in enumerate(cols):
            for j, z in enumerate(cols):
                total = total + F.lit(float(result.vcov[i, j])) * x * z
        return df.withColumn("prediction", F.sqrt(total))
    if kind not in ("fe", "response"):
        raise AbsorbiaError("prediction.kind", f"unknown kind {kind!r}", stage="prediction")
    out, fixed, same = df, F.lit(0.0), F.lit(True)
    solved = solution_of(result)
    tables, slopes = recover(result, solved=solved), recover_slopes(result, solved=solved)
    for i, (t, slope, table) in enumerate(slopes):
        out = out.join(table.select(*t.keys, F.col("effect").alias(f"_s{i}")), list(t.keys), "left")
        fixed = fixed + F.col(f"_s{i}") * F.col(slope).cast("double")
    for i, (t, table) in enumerate(tables):
        out = out.join(table.select(*t.keys, F.col("effect").alias(f"_e{i}"), F.col("component").alias(f"_c{i}")), list(t.keys), "left")
        fixed = fixed + F.col(f"_e{i}")
        same = same & F.col("_c0").eqNullSafe(F.col(f"_c{i}"))
    if unknown == "raise" and (tables or slopes):
        bad = out.agg(F.max(fixed.isNull()), F.max(fixed.isNotNull() & ~same)).first()
        if bad[0]:
            raise AbsorbiaError("prediction.unknown_level", "a level was not in the estimation sample", stage="prediction")
        if bad[1]:
            raise AbsorbiaError("prediction.combination", "levels of different components are combined", stage="prediction", suggestion='unknown="null"')
    fixed = F.when(same, fixed)
    poisson = "poisson" in result.model
    value = fixed if kind == "fe" else (F.exp(xb + fixed) if poisson else xb + fixed)
    return out.withColumn("prediction", value).drop(*[f"_{x}{i}" for x in "ec" for i in range(len(tables))], *[f"_s{i}" for i in range(len(slopes))])
