"""Registered queries."""

from cloakframe.plans import learning, privacy, risks, sampling, scans, statistics  # noqa: F401
from cloakframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
