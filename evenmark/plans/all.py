"""All queries; importing this registers them."""

from . import corpus, feeds, forecast, governance, identity, odds, planning, streams, temporal  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
