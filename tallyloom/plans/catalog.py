"""All queries of the library with their SQL oracles."""

from __future__ import annotations

from tallyloom.plans import episodes, evidence, integrity, metrics, observations, release, sequences, splits, texts, validators  # noqa: F401
from tallyloom.plans.registry import ORACLES, QUERIES  # noqa: F401
