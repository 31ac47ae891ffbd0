"""Lag-window and spectral kernels for serially correlated scores."""

from __future__ import annotations

import math

from absorbia.errors import AbsorbiaError

# Kernel names and their aliases.
ALIASES = {
    "bartlett": "bartlett", "bar": "bartlett", "newey_west": "bartlett", "neweywest": "bartlett", "nw": "bartlett",
    "truncated": "truncated", "tru": "truncated", "uniform": "truncated", "rectangular": "truncated",
    "parzen": "parzen", "par": "parzen",
    "tukey_hanning": "tukey_hanning", "thann": "tukey_hanning", "hann": "tukey_hanning",
    "tukey_hamming": "tukey_hamming", "thamm": "tukey_hamming", "hamm": "tukey_hamming",
    "quadratic_spectral": "quadratic_spectral", "qua": "quadratic_spectral", "qs": "quadratic_spectral",
    "daniell": "daniell", "danielle": "daniell", "dan": "daniell",
    "tent": "tent", "ten": "tent",
}
SPECTRAL = {"quadratic_spectral", "daniell", "tent"}


def canonical(name: str) -> str:
    key = name.lower().replace("-", "_").replace(" ", "_")
    if key not in ALIASES:
        raise AbsorbiaError("inference.kernel", f"unknown kernel {name!r}", stage="inference", suggestion="one of " + ", ".join(sorted(set(ALIASES.values()))))
    return ALIASES[key]


def weight(name: str, lag: int, bandwidth: float) -> float:
    """Weight of the autocovariance at a lag."""
    kind = canonical(name)
    if not (bandwidth > 0 and math.isfinite(bandwidth)):
        raise AbsorbiaError("inference.bandwidth", f"bandwidth {bandwidth} is not a positive number", stage="inference")
    if lag == 0:
        return 1.0
    if kind in SPECTRAL:
        x = lag / bandwidth
        if kind == "quadratic_spectral":
            z = 6 * math.pi * x / 5
            return 25 / (12 * math.pi**2 * x**2) * (math.sin(z) / z - math.cos(z))
        if kind == "daniell":
            return math.sin(math.pi * x) / (math.pi * x)
        return 2 * (1 - math.cos(lag * x)) / x**2
    if lag > math.floor(bandwidth):
        return 0.0
    x = lag / bandwidth
    if kind == "bartlett":
        return max(1 - x, 0.0)
    if kind == "truncated":
        return 1.0
    if kind == "parzen":
        return 1 - 6 * x**2 + 6 * x**3 if x <= 0.5 else 2 * (1 - x) ** 3
    return (0.5 + 0.5 * math.cos(math.pi * x)) if kind == "tukey_hanning" else 0.54 + 0.46 * math.cos(math.pi * x)


def max_lag(name: str, bandwidth: float, span: int) -> int:
    """Spectral kernels use every lag, the others stop at the bandwidth."""
    return span if canonical(name) in SPECTRAL else min(span, math.floor(bandwidth))


def automatic_bandwidth(periods: int) -> float:
    return math.floor(4 * (periods / 100) ** (2 / 9)) + 1
