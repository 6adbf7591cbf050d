"""Registered queries over the driver tables."""

from shelfproof.plans import cards, facts, logs, shelf, shops, stores, webpages, words  # noqa: F401
from shelfproof.plans.registry import ORACLES, QUERIES  # noqa: F401
