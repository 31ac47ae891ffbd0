"""Model specifications: fixed-effect terms, weights, covariance choice, required columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from absorbia.errors import AbsorbiaError

# Aliases of weight types and covariance kinds.
WEIGHT_TYPES = {"fw": "fweight", "fweight": "fweight", "frequency": "fweight", "aw": "aweight", "aweight": "aweight", "analytic": "aweight", "pw": "pweight", "pweight": "pweight", "probability": "pweight", "generic": "generic"}
VCE_KINDS = {"iid": "iid", "unadjusted": "iid", "homoskedastic": "iid", "robust": "robust", "hc1": "robust", "heteroskedastic": "robust", "cluster": "cluster", "clustered": "cluster", "hac": "hac", "newey_west": "hac", "dkraay": "dkraay", "dk": "dkraay", "driscoll_kraay": "dkraay"}


@dataclass(frozen=True)
class FixedEffect:
    """Levels of the interaction of `keys`, with an intercept and/or slopes on other columns."""

    keys: tuple[str, ...]
    slopes: tuple[str, ...] = ()
    intercept: bool = True

    @property
    def name(self) -> str:
        base = "#".join(self.keys)
        if not self.slopes:
            return base
        return base + ("##" if self.intercept else "#") + "c(" + ",".join(self.slopes) + ")"


def fe(*keys: str, slopes: tuple[str, ...] | list[str] | str = (), intercept: bool = True) -> FixedEffect:
    return FixedEffect(tuple(keys), (slopes,) if isinstance(slopes, str) else tuple(slopes), intercept)


def absorb_terms(absorb) -> list[FixedEffect]:
    """A column name, a tuple (an interaction), a FixedEffect, a dict, a factor term, or a list of these."""
    from .factors import Factors

    if absorb is None:
        return []
    if isinstance(absorb, (str, FixedEffect, dict, tuple, Factors)):
        absorb = [absorb]
    out: list[FixedEffect] = []
    for term in absorb:
        if isinstance(term, FixedEffect):
            out.append(term)
        elif isinstance(term, str):
            out.append(FixedEffect((term,)))
        elif isinstance(term, tuple):
            out.append(FixedEffect(tuple(term)))
        elif isinstance(term, dict):
            keys = term["group"]
            out.append(fe(*([keys] if isinstance(keys, str) else keys), slopes=term.get("slopes", ()), intercept=term.get("intercept", True)))
        elif isinstance(term, Factors):
            out += term.absorbed()
        else:
            raise AbsorbiaError("specification.absorb", f"cannot absorb {term!r}", stage="specification")
    return list(dict.fromkeys(out))


def names(spec) -> list[str]:
    return [] if spec is None else [spec] if isinstance(spec, str) else list(spec)


def weight_type(kind: str | None, weights: str | None) -> str | None:
    if kind is not None and weights is None:
        raise AbsorbiaError("specification.weights", "a weight type needs a weight column", stage="specification")
    if weights is None:
        return None
    if (kind or "generic").lower() not in WEIGHT_TYPES:
        raise AbsorbiaError("specification.weights", f"unknown weight type {kind!r}", stage="specification")
    return WEIGHT_TYPES[(kind or "generic").lower()]


def vce_kind(vce: str | None, clusters: list[str], weights: str | None) -> str:
    """A given cluster selects clustering; probability weights turn iid into robust."""
    if vce is None:
        kind = "cluster" if clusters else "iid"
    elif vce.lower() in VCE_KINDS:
        kind = VCE_KINDS[vce.lower()]
    else:
        raise AbsorbiaError("specification.vce", f"unknown covariance {vce!r}", stage="specification")
    if kind == "cluster" and not 1 <= len(clusters) <= 10:
        raise AbsorbiaError("inference.clusters", "one to ten cluster columns are needed", stage="specification")
    return "robust" if kind == "iid" and weights == "pweight" else kind


@dataclass
class Requirements:
    """Columns a model needs, with the roles they play, in order of first use."""

    roles: dict[str, list[str]] = field(default_factory=dict)

    def add(self, role: str, columns) -> Requirements:
        for c in names(columns):
            got = self.roles.setdefault(c, [])
            if role not in got:
                got.append(role)
        return self

    @property
    def columns(self) -> list[str]:
        return list(self.roles)

    @property
    def identifiers(self) -> list[str]:
        return [c for c, r in self.roles.items() if set(r) <= {"fixed_effect", "cluster", "group", "individual", "time", "panel"}]

    @property
    def numeric(self) -> list[str]:
        return [c for c, r in self.roles.items() if not set(r) <= {"fixed_effect", "cluster", "group", "individual", "time", "panel", "factor"}]

    @classmethod
    def of(cls, *, absorb=None, **roles) -> Requirements:
        out = cls()
        for role, columns in roles.items():
            out.add(role, columns)
        for term in absorb_terms(absorb):
            out.add("fixed_effect", term.keys).add("slope", term.slopes)
        return out

    def union(self, other: Requirements) -> Requirements:
        out = Requirements({c: list(r) for c, r in self.roles.items()})
        for c, roles in other.roles.items():
            for r in roles:
                out.add(r, c)
        return out
