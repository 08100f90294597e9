"""Queries on the test tables, each next to the SQL it is checked against."""

from odflux.catalog import (  # noqa: F401
    aggregates,
    analyses,
    filters,
    graphs,
    joins,
    maps,
    places,
    scalars,
    sources,
    texts,
)
from odflux.catalog.registry import ORACLES, QUERIES  # noqa: F401
