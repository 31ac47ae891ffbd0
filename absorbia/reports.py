"""Reports for support: errors without data, and execution plans.

Error reports hold versions, counts and codes of a fixed list, never rows, names of columns, paths,
messages or coefficients. Plan reports hold Spark's formatted plan, which names columns and paths;
they are for the user's own eyes unless `redact` is set.

    python -m absorbia.reports error report.md     writes an empty error report to fill in
    python -m absorbia.reports plan report.md      the same for plans
"""

from __future__ import annotations

import json
import math
import platform
import re
import sys
import traceback
from pathlib import Path

from pyspark.sql import DataFrame

ISSUES = ("crash", "wrong_result", "slow", "memory", "other")
#: Settings of the session that bear on a plan.
SETTINGS = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes")
#: Numbers of a result that tell nothing about single rows or coefficients.
COUNTS = ("n", "n_rows", "n_clusters", "iterations", "df_absorbed", "singletons", "separated", "converged")
_CODE = re.compile(r"[a-z][a-z0-9_]*(\.[a-z0-9_]+)*\Z")


def _number(value):
    if isinstance(value, (bool, int)):
        return value
    return value if isinstance(value, float) and math.isfinite(value) else None


def _code(value) -> str | None:
    return value if isinstance(value, str) and len(value) <= 60 and _CODE.match(value) else None


def error_payload(error: BaseException | None = None, result=None, issue: str = "other", differences: dict[str, float] | None = None) -> dict:
    """What an error report holds. `differences`: sizes of differences from another program, by statistic."""
    import numpy
    import pyspark

    if issue not in ISSUES:
        raise ValueError(f"unknown issue {issue!r}")
    own = [f for f in traceback.extract_tb(error.__traceback__) if "absorbia" in Path(f.filename).parts] if error is not None else []
    stats = getattr(result, "stats", {})
    return {
        "issue": issue,
        "environment": {"python": platform.python_version(), "pyspark": pyspark.__version__, "numpy": numpy.__version__, "system": platform.system(), "machine": platform.machine()},
        "error": None if error is None else {"kind": type(error).__name__, "code": _code(getattr(error, "code", None)), "stage": _code(getattr(error, "stage", None)), "at": [f"{Path(f.filename).stem}.{f.name}" for f in own]},
        "result": None if result is None else {"model": _code(getattr(result, "model", None)), "regressors": len(getattr(result, "names", ())), "fixed_effects": len(getattr(result, "terms", ())), **{k: v for k in COUNTS if (v := _number(stats.get(k))) is not None}},
        "differences": {k: v for k, x in (differences or {}).items() if k in ("coefficient", "std_error", "n", "df") and (v := _number(x)) is not None},
    }


def plan_payload(df: DataFrame, redact: bool = True) -> dict:
    """Operators of a plan with their numbers, the session's settings and, unless redacted, the plan."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    tree = plan.split("\n\n\n")[0]
    operators: dict[str, int] = {}
    for name in re.findall(r"^[ :+*|-]*(?:\* )?([A-Z][A-Za-z]+)(?: parquet| csv| text)?\s.*\(\d+\)\s*$", tree, re.M):
        operators[name] = operators.get(name, 0) + 1
    out = {"operators": dict(sorted(operators.items())), "settings": {k: df.sparkSession.conf.get(k, None) for k in SETTINGS}, "columns": len(df.columns)}
    return out if redact else {**out, "plan": plan}


def markdown(title: str, payload: dict) -> str:
    """A payload as headed tables."""
    lines = [f"# {title}", ""]
    for head, part in payload.items():
        lines += [f"## {head}", ""]
        if isinstance(part, dict) and part:
            lines += ["| Item | Value |", "|--|--|", *(f"| {k} | {', '.join(map(str, v)) if isinstance(v, list) else '' if v is None else v} |" for k, v in part.items())]
        else:
            lines.append("```\n" + part + "\n```" if isinstance(part, str) and "\n" in part else str(part or "none"))
        lines.append("")
    return "\n".join(lines)


def write(path: str, title: str, payload: dict) -> None:
    """JSON where the path ends so, else Markdown; a file that is there stays."""
    with open(path, "x", encoding="utf-8") as f:
        f.write(json.dumps(payload, indent=1) if path.endswith(".json") else markdown(title, payload))


def main(arguments: list[str] | None = None) -> int:
    arguments = sys.argv[1:] if arguments is None else arguments
    if len(arguments) != 2 or arguments[0] not in ("error", "plan"):
        print(__doc__.strip().rpartition("\n\n")[2], file=sys.stderr)
        return 2
    kind, path = arguments
    write(path, f"{kind.title()} report", error_payload() if kind == "error" else {"operators": {}, "settings": dict.fromkeys(SETTINGS), "columns": 0})
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
