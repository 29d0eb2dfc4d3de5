"""Names of all queries and the SQL that must agree with them."""

from __future__ import annotations

import re
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_CTES: dict[str, str] = {}
FAMILIES = (
    "bars", "features", "outcomes", "structure", "quality", "decisions", "sampling", "statistics", "text", "models",
)


def query(name: str, sql: str | None = None, d: str = "", n: str = ""):
    """Register ``fn(spark, sf_dir)``; ``sql`` may use the shared CTEs by name.

    ``d`` names the double columns of the SQL result (rounded like the Spark
    side), ``n`` those to cast to BIGINT.
    """

    def wrap(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(prepare(spark), sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        _QUERIES[name] = run
        if sql is not None:
            fixed = [f'round("{c}", 6) + 0.0::DOUBLE AS "{c}"' for c in d.split()]
            fixed += [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in n.split()]
            outer = f"* REPLACE ({', '.join(fixed)})" if fixed else "*"
            _ORACLES[name] = f"SELECT {outer} FROM ({sql.strip()})"
        return fn

    return wrap


def cte(name: str, sql: str) -> None:
    _CTES[name] = sql.strip()


def _needs(sql: str) -> list[str]:
    seen: list[str] = []

    def visit(text: str, own: str | None) -> None:
        for name in _CTES:
            if name != own and name not in seen and re.search(rf"\b{name}\b", text):
                visit(_CTES[name], name)
                if name not in seen:
                    seen.append(name)

    visit(sql, None)
    return seen


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six decimals (and no negative zero), for value comparison."""
    cols = {
        f.name: F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)
        for f in df.schema
        if f.dataType.typeName() in ("double", "float")
    }
    return df.withColumns(cols) if cols else df


def _load() -> None:
    for family in FAMILIES:
        import_module(f"{__package__}.{family}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Full SQL per query: the shared CTEs it needs, then its own select."""
    _load()
    out = {}
    for name, sql in _ORACLES.items():
        parts = [f"{n} AS ({_CTES[n]})" for n in _needs(sql)]
        head = "WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else ""
        out[name] = head + sql
    return out
