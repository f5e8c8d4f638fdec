"""The registered queries of the library, each with the SQL that must give the same rows."""

from __future__ import annotations

from demandloom.catalogue import base, decide, forecast, models


def _all(what: str) -> dict:
    return {name: got for module in (base, forecast, decide, models) for name, got in getattr(module, what).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLES")
