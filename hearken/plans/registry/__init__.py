"""Named queries over the given tables, with the SQL they are checked against."""

from hearken.plans.registry import corpus, models, sessions, streams, text, vectors
from hearken.plans.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corpus", "models", "sessions", "streams", "text", "vectors"]
