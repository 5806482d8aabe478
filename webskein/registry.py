"""All queries of the library and their SQL, as the driver asks for them."""

from __future__ import annotations

from . import crawl_queries  # noqa: F401  registers its queries
from .queries import ORACLES
from .queries import QUERIES as _QUERIES
from .session import ship

__all__ = ["ORACLES", "QUERIES"]


def _shipping(query):
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _shipping(query) for name, query in _QUERIES.items()}
