"""Registry of the query plans: name -> (Spark plan builder, DuckDB oracle SQL or None).

Each builder takes (spark, sf_dir) and returns a lazy DataFrame over the whole tables. Every computed column is
aliased to the same name on both sides; floating outputs are rounded to 6 digits on both sides.
"""
from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}
DIGITS: dict[str, int] = {}
NUDGE: dict[str, float] = {}
# Fixed value: offset added before rounding where exact decimal ties are common (averages of averages);
# it moves a tie far from the rounding boundary compared with the engines' last-bit differences.
TIE_NUDGE = 3.14159e-10
_MANIFEST = os.path.join(os.path.dirname(__file__), "float_columns.json")


def query(name: str, sql: str | None = None, digits: int = 6, tie_safe: bool = False):
    """Register a plan builder (and its oracle). Floating outputs are rounded half-even to ``digits`` on both
    sides (8 where a value is an average of a few 6-decimal numbers, so that no exact tie reaches the rounding)."""
    def deco(fn: Builder) -> Builder:
        from augeval.plans.stages import round_doubles

        nudge = TIE_NUDGE if tie_safe else 0.0

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir), digits, nudge)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        DIGITS[name] = digits
        NUDGE[name] = nudge
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


def float_columns() -> dict[str, dict[str, str]]:
    """Floating output columns per plan ('scalar' or 'array'), from the committed schema manifest."""
    if not os.path.exists(_MANIFEST):
        return {}
    with open(_MANIFEST, encoding="utf-8") as f:
        return json.load(f)


def rounded_sql(name: str) -> str:
    """The oracle SQL of a plan with the same half-even rounding of its floating columns."""
    sql = ORACLE[name]
    cols = float_columns().get(name, {})
    if not cols:
        return sql
    d = DIGITS.get(name, 6)
    nd = f" + {NUDGE[name]!r}" if NUDGE.get(name) else ""
    parts = [f"round_even({c}{nd}, {d}) AS {c}" if kind == "scalar" else
             f"list_transform({c}, lambda x: round_even(x{nd}, {d})) AS {c}" for c, kind in sorted(cols.items())]
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM (\n{sql}\n) AS q"


def write_manifest(spark: SparkSession, sf_dir: str) -> dict:
    """Record the floating output columns of every plan (analysis only; builders may run small jobs)."""
    from pyspark.sql.types import ArrayType, DoubleType, FloatType
    load_all()
    out = {}
    for name, fn in sorted(QUERIES.items()):
        cols = {}
        for f in fn(spark, sf_dir).schema.fields:
            if isinstance(f.dataType, (DoubleType, FloatType)):
                cols[f.name] = "scalar"
            elif isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, (DoubleType, FloatType)):
                cols[f.name] = "array"
        out[name] = cols
    with open(_MANIFEST, "w", encoding="utf-8") as f:
        json.dump(out, f, indent=1, sort_keys=True)
    return out


def load_all() -> None:
    """Import every module that registers plans."""
    from augeval.plans import (q_curate, q_eval, q_ledger, q_ml, q_report, q_similarity,  # noqa: F401
                               q_streaming)
