"""Imports every plan module, which registers its queries."""

from opsweave.plans import calibration, correlation, detectors, evaluation, features, graph, incidents, ingest  # noqa: F401
from opsweave.plans.registry import ORACLES, PLANS

__all__ = ["ORACLES", "PLANS"]
