"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import cycle_queries, function_queries, landing_queries, merge_queries, report_queries, rule_queries, source_queries, stream_queries  # noqa: F401
from .plans.registered import ORACLES, QUERIES  # noqa: F401
