"""Factor terms: `i(a)`, `c(x)`, `#` (interaction), `##` (full factorial) and `+`."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from absorbia.errors import AbsorbiaError

MAX_WAYS = 8
MAX_TERMS = 4_096
_TOKEN = re.compile(r"\s*(?:(##|#|\+|\(|\))|([A-Za-z_]\w*)|(.))")


@dataclass(frozen=True)
class Factors:
    """A sum of interactions; each a tuple of (kind, column) with kind `i` or `c`."""

    terms: tuple[tuple[tuple[str, str], ...], ...]
    base: str | int | float | None = "first"

    def absorbed(self):
        """As fixed effects: maximal partitions, slopes on a partition gathered, dominated terms gone."""
        from .specs import FixedEffect

        by: dict[tuple[str, ...], list] = {}
        for term in self.terms:
            keys, slopes = tuple(sorted(c for k, c in term if k == "i")), tuple(c for k, c in term if k == "c")
            if not keys and any(slopes[0] in [c for k, c in t if k == "c"] for t in self.terms if any(k == "i" for k, _ in t)):
                continue  # the main effect of `##`: the slopes by level span it
            if not keys or len(slopes) > 1:
                raise AbsorbiaError("specification.absorb", "an absorbed term needs factors and at most one continuous column", stage="specification")
            got = by.setdefault(keys, [False, []])
            got[0] |= not slopes
            got[1] += [s for s in slopes if s not in got[1]]
        out = []
        for keys, (intercept, slopes) in by.items():
            finer = any(set(keys) < set(other) and has for other, (has, _) in by.items())
            if intercept and finer and not slopes:
                continue
            out.append(FixedEffect(keys, tuple(slopes), intercept and not finer or not slopes))
        return out


def parse(text: str, base: str | int | float | None = "first") -> Factors:
    tokens = []
    for m in _TOKEN.finditer(text):
        if m[3]:
            raise AbsorbiaError("specification.factor_syntax", f"unexpected {m[3]!r} at {m.start(3)}", stage="specification")
        tokens.append((m[1] or m[2], m.start()))
    tokens.append(("", len(text)))
    at = 0

    def take(want: str | None = None) -> str:
        nonlocal at
        token, place = tokens[at]
        if not token or want is not None and token != want:
            raise AbsorbiaError("specification.factor_syntax", f"expected {want or 'a term'} at {place}", stage="specification")
        at += 1
        return token

    def atom():
        if tokens[at][0] == "(":
            take()
            inner = total()
            take(")")
            return inner
        kind = take()
        if kind not in ("i", "c"):
            raise AbsorbiaError("specification.factor_syntax", f"expected i( or c( at {tokens[at - 1][1]}", stage="specification")
        take("(")
        column = take()
        take(")")
        return [((kind, column),)]

    def cross(a, b):
        return _tidy([x + y for x in a for y in b])

    def product():
        left = atom()
        while tokens[at][0] in ("#", "##"):
            op, right = take(), atom()
            left = cross(left, right) if op == "#" else _tidy(left + right + cross(left, right))
        return left

    def total():
        left = product()
        while tokens[at][0] == "+":
            take()
            left = _tidy(left + product())
        return left

    terms = total()
    if tokens[at][0]:
        raise AbsorbiaError("specification.factor_syntax", f"unexpected {tokens[at][0]!r} at {tokens[at][1]}", stage="specification")
    return Factors(tuple(terms), base)


def fv(text: str, base: str | int | float | None = "first") -> Factors:
    return parse(text, base)


def _tidy(terms):
    out = []
    for term in terms:
        factors = list(dict.fromkeys(x for x in term if x[0] == "i"))
        term = tuple(sorted(factors)) + tuple(sorted(x for x in term if x[0] == "c"))
        if len(term) > MAX_WAYS:
            raise AbsorbiaError("specification.factor_ways", f"more than {MAX_WAYS} parts in one term", stage="specification")
        if term not in out:
            out.append(term)
    if len(out) > MAX_TERMS:
        raise AbsorbiaError("specification.factor_terms", f"more than {MAX_TERMS} terms", stage="specification")
    return out


def base_level(df: DataFrame, column: str, base: str | int | float | None):
    """The level left out: first, last, most frequent (ties to the lowest), none, or a value."""
    if base in (None, "none"):
        return None
    counts = df.groupBy(column).count()
    if base == "first":
        return counts.agg(F.min(column)).first()[0]
    if base == "last":
        return counts.agg(F.max(column)).first()[0]
    if base in ("freq", "frequent"):
        row = counts.orderBy(F.desc("count"), column).first()
        return row[0] if row else None
    if counts.where(F.col(column) == F.lit(base)).isEmpty():
        raise AbsorbiaError("specification.base", f"{base!r} is not a level of {column}", stage="design")
    return base


def design(df: DataFrame, factors: Factors, omit: set[str] = frozenset()) -> dict[str, Column]:
    """Named numeric columns of the observed cells: `a[x]#b[y]#z`; levels sorted, bases left out."""
    out: dict[str, Column] = {}
    bases = {c: base_level(df, c, factors.base) for t in factors.terms for k, c in t if k == "i"}
    for term in factors.terms:
        cats, nums = [c for k, c in term if k == "i"], [c for k, c in term if k == "c"]
        value = F.lit(1.0)
        for c in nums:
            value = value * F.col(c).cast("double")
        if not cats:
            out["#".join(nums)] = value
            continue
        cells = df.select(*cats).distinct().orderBy(*cats).limit(MAX_TERMS + 1).collect()
        if len(cells) > MAX_TERMS:
            raise AbsorbiaError("specification.factor_terms", f"more than {MAX_TERMS} levels in {'#'.join(cats)}", stage="design", suggestion="absorb the factor instead")
        for cell in cells:
            if any(bases[c] is not None and cell[c] == bases[c] for c in cats):
                continue
            name = "#".join([*(f"{c}[{cell[c]}]" for c in cats), *nums])
            if name in omit or any(f"{c}[{cell[c]}]" in omit for c in cats):
                continue
            inside = F.lit(True)
            for c in cats:
                inside = inside & F.col(c).eqNullSafe(F.lit(cell[c]))
            out[name] = F.when(inside, value).otherwise(F.lit(0.0))
    return out
