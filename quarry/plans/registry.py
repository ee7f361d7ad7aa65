"""Every registered query with its oracle. Plan modules register as they are imported."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir), and the DuckDB SQL with the same rows if there is one."""

    def put(function: Callable) -> Callable:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return put


from quarry.plans import curation, dedup, ledger, labels, sampling, service, serving, sources, text, views, workflow  # noqa: E402,F401
