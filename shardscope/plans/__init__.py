"""The registered queries; importing this package fills the registry."""

from shardscope.plans import cleaning, distribution, evaluation, modelling, profiling, samples, sources  # noqa: F401
from shardscope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
