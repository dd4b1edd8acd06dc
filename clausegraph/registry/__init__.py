"""All registered queries; importing this package fills the registry."""

from clausegraph.registry import answering, channels, checks, evaluation, graphs, guarding, lexical, understanding  # noqa: F401
from clausegraph.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
