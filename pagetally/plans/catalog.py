"""Every query of the library proper, with its SQL."""

from __future__ import annotations

from pagetally.plans import fact_queries, match_queries, report_queries, source_queries, text_queries  # noqa: F401  (they register themselves)
from pagetally.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "d02_e01_number_recall"
