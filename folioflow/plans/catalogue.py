"""Loads all query modules."""

from folioflow.plans import corpus, layout, manifest, metadata, relational, streaming, web  # noqa: F401
from folioflow.plans.registry import ORACLES, QUERIES  # noqa: F401
