"""Every registered query and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..sources.io import ship
from . import dashboards, relational, retrieval, scalar, services, stored, streams


def _ready(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with this package on the workers that it may call."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict = {}
ORACLES: dict = {}
for _module in (retrieval, relational, scalar, dashboards, streams, services, stored):
    QUERIES |= {name: _ready(query) for name, query in _module.QUERIES.items()}
    ORACLES |= _module.ORACLES
