"""Queries of this package and the SQL they are checked with."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of (spark, sf_dir) under a name, with its SQL if there is one."""

    def wrap(build):
        assert name not in QUERIES, name
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return wrap
