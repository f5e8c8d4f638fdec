"""Queries and their SQL are registered side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Catalogue:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None, dates: str = "") -> Callable[[Callable], Callable]:
        """Register a function (spark, sf_dir) under its name; without SQL only its rows are checked, by tests.

        The columns named in dates leave both sides as ISO text, whatever a client makes of a date.
        """
        names = dates.split()

        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = (lambda spark, sf_dir: f(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in names})) if names else f
            if sql is not None:
                self.oracles[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in names)}) FROM ({sql})" if names else sql
            return f

        return add


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded to six places, which two engines agree on; a rounded zero has no sign."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c.cast("double"), 6) + F.lit(0.0)
    return out.alias(name) if name else out


def r6s(c: Column | str, name: str) -> Column:
    """r6 for quotients of money by small counts, which often end in an exact half: all are moved off the boundary."""
    c = F.col(c) if isinstance(c, str) else c
    return r6(c + 3.1e-8, name)
