"""One registry of queries and of the SQL that gives the same rows."""

from __future__ import annotations

import re

from odflux.catalog.inputs import Tables
from odflux.catalog.views import VIEWS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def with_views(text: str, extra: dict[str, str] | None = None) -> str:
    """SQL with the views it names, and the views those name, as common tables."""
    views = {**VIEWS, **(extra or {})}
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"\b[a-z_][a-z_0-9]*\b", sql):
            if name in views and name not in needed and name not in stack:
                stack.append(name)
                visit(views[name])
                stack.pop()
                needed.append(name)

    stack: list[str] = []
    visit(text)
    if not needed:
        return text
    return "with " + ",\n".join(f"{n} as materialized ({views[n]})" for n in needed) + "\n" + text.strip()


def query(name: str, oracle: str | None = None, extra: dict[str, str] | None = None):
    """Register a function of ``Tables`` under a name, with its SQL if there is one."""

    def wrap(build):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = with_views(oracle, extra)
        return build

    return wrap
