"""Where queries and their SQL twins are registered."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plenum.catalog.inputs import SQL_INPUTS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _quoted(sql: str) -> str:
    pieces = re.split(r"('(?:[^']|'')*')", sql)
    pieces[::2] = [re.sub(r"\bnatural\b", '"natural"', p) for p in pieces[::2]]
    return "".join(pieces)


def with_inputs(sql: str) -> str:
    """Prefix the SQL with the derived input tables it mentions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in SQL_INPUTS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    # NATURAL is a keyword of the twin's dialect and a column name here
    visit(sql)
    quoted = {n: _quoted(b) for n, b in SQL_INPUTS.items()}
    sql = _quoted(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{name} AS ({quoted[name]})" for name in needed)
    stripped = sql.strip()
    if stripped.upper().startswith("WITH "):
        return f"WITH {head},\n{stripped[5:]}"
    return f"WITH {head}\n{stripped}"


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a survey key."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_inputs(oracle)
        return fn

    return register
