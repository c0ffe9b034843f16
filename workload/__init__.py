"""The library bound to the supplied tables, each query with its SQL twin."""

from workload import addresses, market, storage, training  # noqa: F401
from workload.registry import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS"]
