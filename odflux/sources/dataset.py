"""Registry of prepared tables: three time grains by two place levels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflux.operators.joins import left_join_fill
from odflux.operators.sorting import timeline
from odflux.sources.files import clean_edges


@dataclass(frozen=True)
class Dataset:
    graph: DataFrame
    centrality: DataFrame
    clusters: DataFrame

    @property
    def centrality_columns(self) -> list[str]:
        return [c for c in self.centrality.columns if c not in ("name", "time")]

    @property
    def cluster_columns(self) -> list[str]:
        return [c for c in self.clusters.columns if c not in ("name", "time")]

    @property
    def times(self) -> DataFrame:
        return timeline(self.graph)


def dataset(graph: DataFrame, centrality: DataFrame, demand: DataFrame, clusters: DataFrame) -> Dataset:
    """Edges without self edges, centrality with demand columns, cluster labels."""
    as_text = lambda df: df.withColumn("time", F.col("time").cast("string"))
    return Dataset(
        graph=clean_edges(as_text(graph)),
        centrality=left_join_fill(as_text(centrality), as_text(demand), ["name", "time"]),
        clusters=as_text(clusters),
    )


class Catalog:
    """Data sets by (time grain, place level), each kept in memory once asked for."""

    def __init__(self):
        self._sets: dict[tuple[str, str], Dataset] = {}

    def add(self, graph_name: str, coarse: str, data: Dataset, cache: bool = False) -> None:
        if cache:
            data = Dataset(data.graph.cache(), data.centrality.cache(), data.clusters.cache())
        self._sets[graph_name, coarse] = data

    def get(self, graph_name: str, coarse: str) -> Dataset:
        return self._sets[graph_name, coarse]

    def keys(self) -> list[tuple[str, str]]:
        return sorted(self._sets)
