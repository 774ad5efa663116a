"""All registered queries; importing the modules fills the register."""

from runloom.plans import dashboards, ingestion, searches, streams, upkeep  # noqa: F401
from runloom.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
