"""Registry of named queries: a Spark callable plus, where SQL can say it, the DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from checks.adapters import PRELUDE, Tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, tuple[str, str]] = {}


def check(name: str, sql: str | None = None, needs: str = ""):
    """Register ``fn(Tables) -> DataFrame``; ``needs`` names the shared CTEs the oracle reads."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = (sql, needs)
        return fn

    return add


def with_prelude(sql: str, needs: str) -> str:
    wanted: list[str] = []

    def visit(cte: str):
        deps, _ = PRELUDE[cte]
        for d in deps.split():
            visit(d)
        if cte not in wanted:
            wanted.append(cte)

    for cte in needs.split():
        visit(cte)
    if not wanted:
        return sql.strip()
    ctes = ",\n".join(f"{c} AS ({PRELUDE[c][1].strip()})" for c in wanted)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def oracle_texts() -> dict[str, str]:
    return {name: with_prelude(*parts) for name, parts in ORACLES.items()}
