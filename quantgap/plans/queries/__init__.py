"""Registered queries and their SQL counterparts."""

from quantgap.plans.queries import cells, distances, models, recodes, resampling, series, tables  # noqa: F401
from quantgap.plans.queries.base import ORACLES, QUERIES  # noqa: F401
