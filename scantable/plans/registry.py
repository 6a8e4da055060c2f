"""All core queries and their SQL, by name."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scantable.plans.rounded import CASTS, COLUMNS

Query = Callable[[SparkSession, str], DataFrame]

DIGITS = 9
_MODULES = ("raw_records", "scalars", "evidence", "structure", "tracks", "reports", "ordered", "paired", "recursions")
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if SQL can state it."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def state(name: str, sql: str) -> None:
    """Add the SQL of a query that is registered elsewhere."""
    _SQL[name] = sql


def recursive(names: str, body: str) -> str:
    """SQL over the named relations that recurses."""
    from scantable.plans.views import with_views

    return "WITH RECURSIVE" + with_views(names, body)[4:]


def suppression(key: str, order: str) -> str:
    """CTEs kept(key, id): rows(key, id, ...) in order, each kept if no kept one is among those it conflicts with (pair(key, a, b))."""
    return f""", ends AS (SELECT {key}, a AS id, b AS other FROM pair UNION ALL SELECT {key}, b, a FROM pair), nb AS (SELECT {key}, id, list(other) AS others FROM ends GROUP BY ALL),
    q AS (SELECT r.*, coalesce(others, []) AS others, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS i FROM rows r LEFT JOIN nb USING ({key}, id)),
    w AS (SELECT DISTINCT {key}, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ids FROM rows UNION ALL SELECT {', '.join('w.' + k.strip() for k in key.split(','))}, q.i, CASE WHEN list_has_any(w.ids, q.others) THEN w.ids ELSE list_append(w.ids, q.id) END
        FROM w JOIN q ON {' AND '.join(f'q.{k.strip()} = w.{k.strip()}' for k in key.split(','))} AND q.i = w.i + 1),
    kept AS (SELECT {key}, unnest(ids) AS id FROM (SELECT {key}, arg_max(ids, i) AS ids FROM w GROUP BY ALL))"""


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"scantable.plans.{name}")


def _rounded(f: Query, columns: tuple[str, ...]) -> Query:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(spark, sf_dir).withColumns({c: F.round(c, DIGITS) for c in columns})

    return run


def queries() -> dict[str, Query]:
    """Name -> query."""
    _load()
    return {name: _rounded(f, COLUMNS[name]) if name in COLUMNS else f for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name -> SQL."""
    _load()
    out = {}
    for name, sql in _SQL.items():
        kind, cast = CASTS.get(name, ("", ()))
        shown = [f"round({c}, {DIGITS}) AS {c}" for c in COLUMNS.get(name, ())] + [f"CAST({c} AS {kind}) AS {c}" for c in cast]
        out[name] = f"SELECT * REPLACE ({', '.join(shown)}) FROM ({sql})" if shown else sql
    return out
