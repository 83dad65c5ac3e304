"""Named queries over the sample tables and their SQL counterparts."""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def norm(x: str) -> str:
    """Text key in SQL (the sample names are ASCII)."""
    return f"regexp_replace(lower({x}), '[\\s,.;:()<>/_\"''\\[\\]\\\\-]+', '', 'g')"


def core(x: str) -> str:
    """Name core of the demo pack in SQL."""
    return (f"regexp_replace(replace(regexp_replace({norm(x)}, '^(hot|cold)+', ''), 'gizmo', 'gadget'), "
            "'([a-z])[0-9]{1,2}$', '\\1')")


def half_up(x: str, digits: int) -> str:
    """Round half up on the shortest decimal text of a double."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


def category(x: str) -> str:
    return ("CASE " + " ".join(
        f"WHEN contains({norm(x)}, '{w}') THEN '{w}'" for w in
        ("ring", "widget", "bolt", "gear", "gizmo", "plate", "anvil", "rod")) + " ELSE '' END")
