"""All registered queries; importing this package fills the registry."""

from checks import aggregation, cleaning, regression, rules_and_scores, texts  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
