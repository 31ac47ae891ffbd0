"""Settings that several fits share, and how they meet the arguments of a single fit."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields

from absorbia.errors import AbsorbiaError

MODES = ("stata_compat", "unified")


def _one_of(name: str, value, allowed) -> None:
    if value not in allowed:
        raise AbsorbiaError(f"specification.{name}", f"{name} is {value!r}, not one of {sorted(allowed)}", stage="specification")


def singleton_mode(mode: str) -> str:
    _one_of("singleton_mode", mode, MODES)
    return mode


@dataclass(frozen=True)
class Sampling:
    """Which rows stay.

    The mode matters in Poisson models: at first stata_compat counts rows, whatever their frequency
    weights, and looks for all-zero levels only where singletons are dropped; unified counts the
    frequencies and looks for all-zero levels in any case. Linear models count frequencies in both.
    """

    drop_singletons: bool = True
    singleton_mode: str = "stata_compat"

    def __post_init__(self):
        singleton_mode(self.singleton_mode)

    def options(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class Absorption:
    """How redundant levels are counted."""

    dof: str = "pairwise"

    def __post_init__(self):
        _one_of("dof", self.dof, ("pairwise", "firstpair", "none", "exact"))

    def options(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class Inference:
    """Covariance and what it needs; None leaves it to the fit."""

    vce: str | None = None
    cluster: str | tuple[str, ...] | None = None
    time: str | None = None
    panel: str | None = None
    kernel: str | None = None
    bandwidth: float | None = None

    def __post_init__(self):
        if self.bandwidth is not None and not self.bandwidth > 0:
            raise AbsorbiaError("specification.config", "a bandwidth is positive", stage="specification")

    def options(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None}


@dataclass(frozen=True)
class Config:
    sampling: Sampling = field(default_factory=Sampling)
    absorption: Absorption = field(default_factory=Absorption)
    inference: Inference = field(default_factory=Inference)

    def options(self) -> dict:
        return {**self.sampling.options(), **self.absorption.options(), **self.inference.options()}


def resolve(config: Config | None, given: dict) -> dict:
    """Options of one fit. An argument that says something else than a setting changed from its default is a conflict."""
    if config is None:
        return given
    default, out = Config().options(), config.options()
    for name, value in given.items():
        if name in out and out[name] != default.get(name) and out[name] != value:
            raise AbsorbiaError("specification.config_conflict", f"{name} is {value!r} here and {out[name]!r} in the settings", stage="specification", argument=name)
        out[name] = value
    return out


def configured(fit, config: Config):
    """fit with the settings of config filled in."""
    def run(*args, **given):
        return fit(*args, **resolve(config, given))

    return run
