"""Registered queries with their oracle SQL.

A check is a Spark function, the SQL that must give the same rows, and the
columns compared: ``s`` text, ``d`` date, ``i`` integer, a number for the
digits a double is rounded to.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import tune


@dataclass(frozen=True)
class Check:
    run: Callable[[SparkSession, str], DataFrame]
    columns: dict[str, str | int]
    sql: str | None


# Both sides round at a threshold that lies between decimal fractions, so that a
# value ending in 5 does not hinge on the last bit of a sum.
OFF_GRID = 0.3719

CHECKS: dict[str, Check] = {}


def check(name: str, columns: dict[str, str | int], sql: str | None = None):
    def register(fn):
        if name in CHECKS:
            raise ValueError(f"{name} is registered twice")
        CHECKS[name] = Check(fn, columns, sql)
        return fn

    return register


def spark_rows(name: str) -> Callable[[SparkSession, str], DataFrame]:
    c = CHECKS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = c.run(tune(spark), sf_dir)
        made = []
        for column, kind in c.columns.items():
            x = F.col(column)
            if kind == "d":
                x = F.date_format(x, "yyyy-MM-dd")
            elif kind == "s":
                x = x.cast("string")
            elif kind == "i":
                x = x.cast("bigint")
            else:
                x = F.floor(x.cast("double") * F.lit(10.0**kind) + F.lit(OFF_GRID)) / F.lit(10.0**kind)
            made.append(x.alias(column))
        return df.select(*made)

    return run


def oracle(name: str) -> str | None:
    c = CHECKS[name]
    if c.sql is None:
        return None
    made = []
    for column, kind in c.columns.items():
        x = f'"{column}"'
        if kind in ("d", "s"):
            x = f"CAST({x} AS VARCHAR)"
        elif kind == "i":
            x = f"CAST({x} AS BIGINT)"
        else:
            x = f"floor(CAST({x} AS DOUBLE) * {10.0**kind:.1f}::DOUBLE + {OFF_GRID}::DOUBLE) / {10.0**kind:.1f}::DOUBLE"
        made.append(f'{x} AS "{column}"')
    return f"SELECT {', '.join(made)} FROM (\n{c.sql}\n) AS answer"


# --- SQL building blocks --------------------------------------------------------


def full(agg: str, x: str, n: int) -> str:
    """Aggregate over ``n`` known values, NULL while fewer are there."""
    return f"CASE WHEN count({x}) OVER w{n} = {n} THEN {agg}({x}) OVER w{n} END"


def named_windows(body: str) -> str:
    """``body`` plus a WINDOW clause for the frames ``w``, ``wN`` and ``history`` it uses."""
    base = "PARTITION BY Symbol ORDER BY Date"
    clauses = []
    if re.search(r"OVER w\b", body):
        clauses.append(f"w AS ({base})")
    if "OVER history" in body:
        clauses.append(f"history AS ({base} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    for n in sorted({int(m) for m in re.findall(r"OVER w(\d+)\b", body)}):
        clauses.append(f"w{n} AS ({base} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")
    for n in sorted({int(m) for m in re.findall(r"OVER before(\d+)\b", body)}):
        clauses.append(f"before{n} AS ({base} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)")
    return body + ("\nWINDOW " + ",\n       ".join(clauses) if clauses else "")


def layer(name: str, source: str, columns: dict[str, str], carry: str = "*") -> str:
    """A CTE adding ``columns`` to ``source``."""
    made = ",\n    ".join(f"{expr} AS {alias}" for alias, expr in columns.items())
    return f"{name} AS (\n" + named_windows(f"SELECT {carry},\n    {made}\nFROM {source}") + ")"


KEY_COLUMNS: dict[str, str | int] = {"Symbol": "s", "Date": "d"}
