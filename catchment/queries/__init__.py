"""All registered queries; importing this package fills the tables."""

from .registry import ORACLES, QUERIES
from . import audit, scalars, joins, location, measures, quality, sources, places, messages, streaming, generate  # noqa: F401

__all__ = ["QUERIES", "ORACLES"]
