"""Registered queries and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import functions as F

from loomspan.operators.tables import bounded
from loomspan.plans.views import oracle

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *extra: tuple[str, str], recursive: bool = False, doubles: tuple[str, ...] = ()):
    """Registers a function ``(spark, sf_dir) -> DataFrame`` under its name, with the SQL that gives the same rows.

    ``doubles`` are rounded to six places on both sides, as two engines add up in other orders.
    """

    def register(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(spark, sf_dir):
            bounded(spark)
            out = f(spark, sf_dir)
            return out.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in doubles}) if doubles else out

        QUERIES[f.__name__] = run
        if sql:
            full = oracle(sql, *extra, recursive=recursive)
            shown = ", ".join(f"round(cast({c} as double), 6) as {c}" for c in doubles)
            ORACLES[f.__name__] = f"select * replace ({shown}) from ({full})" if doubles else full
        return QUERIES[f.__name__]

    return register
