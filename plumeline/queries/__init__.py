"""Queries on the driver's tables, and the SQL that checks them."""

from . import analytics, cases, more, records, relational, scenes, shape, spatial, twins  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
