"""Imports every module that registers queries."""

from sitemetrics.plans import changes, history, live, quality, reports, streams  # noqa: F401
from sitemetrics.plans.registry import ORACLES, QUERIES  # noqa: F401
