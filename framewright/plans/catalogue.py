"""All queries of the engine (without the llm subpackage)."""

from framewright.plans import aggregates, annotations, exports, flows, joins, numerics, scalars, scans, texts, windows  # noqa: F401
from framewright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
