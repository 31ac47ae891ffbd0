"""Many specifications over one projected, cached table."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame

from absorbia.plans.specs import Requirements, absorb_terms
from absorbia.sources.cache import ResultStore
from absorbia.sources.readers import project, source_fingerprint

from .absorb import residualize
from .iv import iv
from .ols import ols, ols_many


class Session:
    """Fits that share the union of their columns, read once; results are kept by specification."""

    def __init__(self, df: DataFrame, specs: list[dict] | None = None, store: ResultStore | None = None):
        need = Requirements()
        for s in specs or []:
            need = need.union(Requirements.of(outcome=s["y"], regressor=[x for x in ([s["x"]] if isinstance(s.get("x"), str) else s.get("x", s.get("exog", []))) if isinstance(x, str)], endogenous=s.get("endog"), instrument=s.get("instruments"), weights=s.get("weights"), cluster=s.get("cluster"), time=s.get("time"), panel=s.get("panel"), absorb=s.get("absorb")))
        self.frame = (project(df, need.columns) if specs else df).persist()
        self.store, self.done, self.projected, self.hits = store, {}, {}, 0
        self._source = source_fingerprint(self.frame) if store else ""

    def _key(self, kind: str, spec: dict) -> str:
        return hashlib.sha256((self._source + kind + json.dumps(spec, sort_keys=True, default=str)).encode()).hexdigest()[:32]

    def fit(self, **spec):
        kind = "iv" if "endog" in spec else "ols"
        key = self._key(kind, spec)
        if key in self.done:
            self.hits += 1
            return self.done[key]
        self.done[key] = result = (iv if kind == "iv" else ols)(self.frame, **spec)
        if self.store:
            self.store.save_result(key, result.publication())
        return result

    def published(self, **spec) -> dict:
        """The plain result, from the store of an earlier session if it has it."""
        key = self._key("iv" if "endog" in spec else "ols", spec)
        kept = self.store.load_result(key) if self.store and key not in self.done else None
        return kept or self.fit(**spec).publication()

    def fit_many(self, specs: list[dict]) -> list:
        return [self.fit(**s) for s in specs]

    def fit_many_y(self, outcomes: list[str], **spec) -> list:
        """Fits of several outcomes; those of least squares not yet done share one projection."""
        if "endog" in spec:
            return [self.fit(y=y, **spec) for y in outcomes]
        keys = {y: self._key("ols", {"y": y, **spec}) for y in outcomes}
        new = [y for y, key in keys.items() if key not in self.done]
        self.hits += len(outcomes) - len(new)
        for y, result in zip(new, ols_many(self.frame, new, **spec) if new else []):
            self.done[keys[y]] = result
            if self.store:
                self.store.save_result(keys[y], result.publication())
        return [self.done[keys[y]] for y in outcomes]

    def within(self, variables: list[str], absorb, weights: str | None = None) -> DataFrame:
        """The frame with {variable}_r, residuals on the terms; kept for the session, and in the store for later ones."""
        terms = absorb_terms(absorb)
        key = "within-" + self._key("within", {"variables": variables, "absorb": [(t.keys, t.slopes, t.intercept) for t in terms], "weights": weights})
        if key not in self.projected:
            make = lambda: residualize(self.frame, terms, variables, weights)[0]
            self.projected[key] = self.store.table(key, make) if self.store else make().persist()
        return self.projected[key]

    def close(self) -> None:
        self.frame.unpersist()
        for result in self.done.values():
            result.release()
        for table in self.projected.values():
            table.unpersist()
        self.projected.clear()
        self.done.clear()
