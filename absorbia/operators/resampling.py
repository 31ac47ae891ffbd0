"""Wild cluster bootstrap from cluster sums, resampled clusters, jackknife, cluster diagnostics."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, functions as F

from absorbia.errors import AbsorbiaError

from . import moments as M

#: Cluster sums that the driver may hold.
MAX_CLUSTERS = 1_000_000


def wild_weights(kind: str, shape: tuple[int, ...], rng) -> np.ndarray:
    """Rademacher, Mammen, Webb's six points, or standard normal."""
    if kind == "rademacher":
        return rng.integers(0, 2, shape) * 2.0 - 1
    if kind == "mammen":
        r = np.sqrt(5)
        return np.where(rng.random(shape) < (r + 1) / (2 * r), (1 - r) / 2, (1 + r) / 2)
    if kind == "webb":
        return np.array([-np.sqrt(1.5), -1, -np.sqrt(0.5), np.sqrt(0.5), 1, np.sqrt(1.5)])[rng.integers(0, 6, shape)]
    if kind == "normal":
        return rng.standard_normal(shape)
    raise AbsorbiaError("resampling.weights", f"unknown multipliers {kind!r}", stage="resampling")


def wild_cluster_test(result, cluster: str, term: str, value: float = 0.0, reps: int = 999, kind: str = "rademacher", restricted: bool = True, seed: int = 0, batch: int = 256) -> dict:
    """Studentised wild cluster bootstrap of one coefficient; all sign patterns where there are few clusters.

    Rows are summed by cluster once (scores and Gram matrices), and every draw works on those sums.
    """
    k, j = len(result.names), result.names.index(term)
    w = F.col("_w")
    x = [F.col(f"`{n}_r`") for n in result.names]
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    sums = result.rows.groupBy(cluster).agg(*[F.sum(w * x[a] * F.col(f"`{result.outcome}_r`")).alias(f"y{a}") for a in range(k)], *[F.sum(w * x[a] * x[b]).alias(f"g{n}") for n, (a, b) in enumerate(pairs)])
    table = sums.limit(MAX_CLUSTERS + 1).toArrow()
    count = table.num_rows
    if not 2 <= count <= MAX_CLUSTERS:
        raise AbsorbiaError("resampling.clusters", f"{count} clusters", stage="resampling")
    sy = np.stack([table[f"y{a}"].to_numpy() for a in range(k)], axis=1)
    gg = np.zeros((count, k, k))
    for n, (a, b) in enumerate(pairs):
        gg[:, a, b] = gg[:, b, a] = table[f"g{n}"].to_numpy()
    bread = M.inverse(gg.sum(axis=0))
    beta = bread @ sy.sum(axis=0)
    center = beta.copy()
    if restricted:
        others = [i for i in range(k) if i != j]
        center[j] = value
        if others:
            a = gg.sum(axis=0)
            center[others] = np.linalg.solve(a[np.ix_(others, others)], sy.sum(axis=0)[others] - a[others, j] * value)
    scores = sy - gg @ center

    def t_of(b, s, null):
        meat = np.einsum("...ga,...gb->...ab", s, s)
        v = np.einsum("a,...ab,b->...", bread[j], meat, bread[j])
        return (b - null) / np.sqrt(v)

    observed = t_of(beta[j], sy - gg @ beta, value)
    rng, null = np.random.default_rng(seed), value if restricted else beta[j]
    exact = kind == "rademacher" and count <= 16 and 2**count <= max(reps, 99)
    total = 2**count if exact else reps
    draws = []
    step = min(batch, draws_at_once(count, 2 * k + 1))
    for at in range(0, total, step):
        m = min(step, total - at)
        v = (((np.arange(at, at + m)[:, None] >> np.arange(count)) & 1) * 2.0 - 1) if exact else wild_weights(kind, (m, count), rng)
        moved = v[:, :, None] * scores
        b = center + moved.sum(axis=1) @ bread
        s = moved - np.einsum("gab,rb->rga", gg, b - center)
        draws.append(t_of(b[:, j], s, null))
    t = np.concatenate(draws)
    t = t[np.isfinite(t)]
    if len(t) < 0.95 * total:
        raise AbsorbiaError("resampling.draws", "too few finite draws", stage="resampling")
    extreme = int((np.abs(t) >= abs(observed) * (1 - 1e-10)).sum())
    return {"statistic": float(observed), "p_value": extreme / len(t) if exact else (1 + extreme) / (len(t) + 1), "draws": len(t), "exact": exact, "clusters": count}


def wild_bootstrap(result, cluster: str, reps: int = 999, kind: str = "rademacher", seed: int = 0) -> np.ndarray:
    """Draws x coefficients: the estimate plus bread times the cluster scores, each with a random multiplier."""
    w, k = F.col("_w"), len(result.names)
    scores = [w * F.col("_resid") * F.col(f"`{n}_r`") for n in result.names]
    table = result.rows.groupBy(cluster).agg(*[F.sum(s).alias(f"s{i}") for i, s in enumerate(scores)]).orderBy(cluster).limit(MAX_CLUSTERS + 1).toArrow()
    if not 2 <= table.num_rows <= MAX_CLUSTERS:
        raise AbsorbiaError("resampling.clusters", f"{table.num_rows} clusters", stage="resampling")
    sums = np.stack([table[f"s{i}"].to_numpy() for i in range(k)], axis=1)
    bread = M.inverse(M.gram(result.rows, [F.col(f"`{n}_r`") for n in result.names], weight=w))
    rng, out, step = np.random.default_rng(seed), [], draws_at_once(len(sums), 1)
    for at in range(0, reps, step):
        out.append(result.beta + wild_weights(kind, (min(step, reps - at), len(sums)), rng) @ sums @ bread)
    return np.concatenate(out)


def draws_at_once(clusters: int, width: int, budget: int = 256 << 20) -> int:
    """How many draws of clusters x width doubles fit the budget, at least one."""
    return max(1, budget // (8 * clusters * width))


def pairs_bootstrap(fit: Callable[[DataFrame], np.ndarray], df: DataFrame, cluster: str, reps: int = 199, seed: int = 0) -> np.ndarray:
    """Draws x coefficients of fits on clusters drawn with replacement; `_draw` tells the copies of a cluster apart."""
    from .levels import codes

    index = codes(df, [cluster], "_c").persist()
    salts = np.random.SeedSequence(seed).generate_state(reps, np.uint32).astype(int).tolist()
    try:
        return replicates(lambda i: fit(draw_clusters(df, cluster, salts[i], index=index)), reps)
    finally:
        index.unpersist()


def draw_clusters(df: DataFrame, cluster: str, seed: int, name: str = "_draw", index: DataFrame | None = None) -> DataFrame:
    """Clusters drawn with replacement, each draw with an id of its own.

    Draws are numbered by a hash-ordered cluster index; a cluster's rows are copied as often as
    its index is drawn. `index` (cluster, _c: codes from 0) spares numbering again for each draw.
    """
    from .levels import codes

    index = codes(df, [cluster], "_c") if index is None else index
    n = index.count()
    picks = df.sparkSession.range(n).select(F.col("id").alias(name), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).alias("_c"))
    return df.join(index, cluster).join(picks, "_c").drop("_c")


def replicates(fit: Callable[[int], np.ndarray], reps: int, least: float = 0.95) -> np.ndarray:
    """Coefficients of seeds 0..reps-1; failures are skipped, but not too many."""
    out = []
    for seed in range(reps):
        try:
            out.append(np.asarray(fit(seed), float))
        except (AbsorbiaError, np.linalg.LinAlgError):
            continue
    if len(out) < least * reps:
        raise AbsorbiaError("resampling.draws", f"{reps - len(out)} of {reps} replicates failed", stage="resampling")
    return np.stack(out)


def random_half(df: DataFrame, columns: list[str], seed: int, tries: int = 32):
    """column -> half (0 or 1) of its value by a hash, alike for all columns; neither half is empty."""
    for attempt in range(tries):
        half = lambda c, a=attempt: F.pmod(F.xxhash64(F.lit(seed), F.lit(a), F.col(c)), F.lit(2))
        seen = df.agg(*[f(half(c)) for c in columns for f in (F.min, F.max)]).first()
        if set(seen) == {0, 1}:
            return half
    raise AbsorbiaError("resampling.split", "a split needs at least two units", stage="resampling")


def split_panel_jackknife(fit: Callable[[DataFrame], np.ndarray], df: DataFrame, kind: str = "A", *, time: str | None = None, unit: str | None = None, exporter: str | None = None, importer: str | None = None, seed: int = 0, time_mid: float | None = None, shared_halves: bool = True) -> dict:
    """Bias-corrected coefficients from fits on parts of a panel.

    A: 3b - t - u, with the means over the halves of the time span (t) and of the units (u).
    B: 2b - c, with the mean over the four pairs of a half of the exporters and one of the importers.
    C: 4b - 2c - 2t + x, where x is the mean over those four in each half of the time span.
    Exporters and importers are halved alike unless shared_halves is off.
    """
    needed = {"A": {"time": time, "unit": unit}, "B": {"exporter": exporter, "importer": importer}, "C": {"time": time, "exporter": exporter, "importer": importer}}.get(kind)
    if needed is None:
        raise AbsorbiaError("resampling.jackknife", f"unknown kind {kind!r}", stage="resampling")
    if missing := [k for k, c in needed.items() if c not in df.columns]:
        raise AbsorbiaError("resampling.panel_columns", f"no column for {', '.join(missing)}", stage="resampling")
    mean = lambda masks: np.mean([np.asarray(fit(df.where(m)), float) for m in masks], axis=0)
    late = []
    if kind != "B":
        if time_mid is None:
            time_mid = middle_of(df, time)
        late = [F.col(time) <= time_mid, F.col(time) > time_mid]
    b = np.asarray(fit(df), float)
    if kind == "A":
        half = random_half(df, [unit], seed)
        t, u = mean(late), mean([half(unit) == i for i in (0, 1)])
        return {"estimate": 3 * b - t - u, "full": b, "time": t, "unit": u, "fits": 5}
    if shared_halves:
        export_half = import_half = random_half(df, [exporter, importer], seed)
    else:
        export_half, import_half = random_half(df, [exporter], 2 * seed), random_half(df, [importer], 2 * seed + 1)
    quarters = [(export_half(exporter) == i) & (import_half(importer) == j) for i in (0, 1) for j in (0, 1)]
    c = mean(quarters)
    if kind == "B":
        return {"estimate": 2 * b - c, "full": b, "country": c, "fits": 5}
    t, x = mean(late), mean([q & h for q in quarters for h in late])
    return {"estimate": 4 * b - 2 * c - 2 * t + x, "full": b, "country": c, "time": t, "cross": x, "fits": 15}


def middle_of(df: DataFrame, time: str) -> float:
    """The last time of the first half of the span."""
    low, high = df.agg(F.min(time), F.max(time)).first()
    if low is None:
        raise AbsorbiaError("resampling.split", "no times to split", stage="resampling")
    return (low + high) // 2


def jackknife_bootstrap(fit: Callable[[DataFrame], np.ndarray], df: DataFrame, kind: str = "A", *, time: str | None = None, unit: str | None = None, exporter: str | None = None, importer: str | None = None, pair: str | None = None, reps: int = 999, seed: int = 0, confidence: float = 0.95) -> dict:
    """Cluster bootstrap of the split-panel jackknife: units are drawn for A, pairs for B and C.

    The time split stays that of the whole panel. Draws that fail are skipped and counted. Gives the
    point estimate, draws, their standard deviation, percentile bounds and the error these imply.
    """
    from .levels import codes

    if reps < 2 or not 0 < confidence < 1:
        raise AbsorbiaError("resampling.bootstrap", "at least two draws, and a confidence between 0 and 1", stage="resampling")
    cluster = unit if kind == "A" else pair
    if cluster not in df.columns:
        raise AbsorbiaError("resampling.panel_columns", "no column of units or pairs to draw", stage="resampling")
    panel = {"time": time, "unit": unit, "exporter": exporter, "importer": importer}
    point = split_panel_jackknife(fit, df, kind, **panel, seed=seed)
    middle = None if kind == "B" else middle_of(df, time)
    index, draws = codes(df, [cluster], "_c"), []
    salts = np.random.SeedSequence(seed).generate_state(reps, np.uint32).astype(int).tolist()
    for salt in salts:
        try:
            got = split_panel_jackknife(fit, draw_clusters(df, cluster, salt, index=index).drop("_draw"), kind, **panel, seed=salt, time_mid=middle, shared_halves=False)["estimate"]
        except (AbsorbiaError, np.linalg.LinAlgError):
            continue
        if got.shape == point["estimate"].shape and np.isfinite(got).all():
            draws.append(got)
    if len(draws) < 2:
        raise AbsorbiaError("resampling.draws", f"{reps - len(draws)} of {reps} draws failed", stage="resampling")
    low, high = np.quantile(draws, [(1 - confidence) / 2, (1 + confidence) / 2], axis=0)
    return {"point": point, "draws": np.stack(draws), "std_error": np.std(draws, axis=0, ddof=1), "ci_low": low, "ci_high": high, "std_error_implied": (high - low) / (2 * NormalDist().inv_cdf((1 + confidence) / 2)), "completed": len(draws), "failed": reps - len(draws)}


def cluster_diagnostics(df: DataFrame, clusters: list[str]) -> DataFrame:
    """One row a cluster column: number, least, median, mean and largest size, variation, shares."""
    out = None
    for c in clusters:
        sizes = df.groupBy(c).agg(F.count(F.lit(1)).cast("double").alias("n"))
        row = sizes.agg(
            F.lit(c).alias("cluster"), F.count(F.lit(1)).alias("clusters"), F.min("n").alias("min_size"), F.median("n").alias("median_size"), F.avg("n").alias("mean_size"), F.max("n").alias("max_size"),
            (F.stddev_pop("n") / F.avg("n")).alias("cv"), (F.max("n") / F.sum("n")).alias("largest_share"), (F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("effective_clusters"), F.count_if(F.col("n") == 1).alias("singleton_clusters"),
        )
        out = row if out is None else out.unionByName(row)
    return out
