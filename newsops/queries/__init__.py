"""Registered queries over the test tables."""

from . import bundles, intake, matching, ranking, rules, runs, scalar  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
