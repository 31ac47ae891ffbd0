"""Structured errors."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np


class AbsorbiaError(Exception):
    """An error with a stable code, the stage that raised it, details and a suggestion."""

    def __init__(self, code: str, message: str, *, stage: str = "", suggestion: str = "", **details):
        super().__init__(f"[{code}] {message}" + (f" ({suggestion})" if suggestion else ""))
        self.code, self.stage, self.suggestion, self.details = code, stage, suggestion, details


#: Kinds of foreign errors and the codes they become.
FOREIGN = ((np.linalg.LinAlgError, "numerics.singular"), (KeyError, "specification.unknown_name"), (ValueError, "specification.value"), (FloatingPointError, "numerics.overflow"))


@contextmanager
def boundary(stage: str):
    """Errors of numpy and Python as AbsorbiaError with a code and the stage; others pass.

    Also a decorator of estimators. Errors of Spark pass as they are: they tell of jobs, not of models.
    """
    try:
        yield
    except AbsorbiaError:
        raise
    except tuple(kind for kind, _ in FOREIGN) as e:
        code = next(code for kind, code in FOREIGN if isinstance(e, kind))
        raise AbsorbiaError(code, str(e) or type(e).__name__, stage=stage, cause=type(e).__name__) from e
