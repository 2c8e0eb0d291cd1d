"""All registered queries: importing this module fills the registry."""

from __future__ import annotations

from tallyspan.plans.queries import joins, ledger, market, obligations, rollups, routes, tallies  # noqa: F401
from tallyspan.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
