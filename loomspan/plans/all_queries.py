"""All registered queries of the library's own operators."""

from loomspan.plans import contracts, derived_sources, names_and_findings, ranks_and_changes, references, shapes, texts_and_streams, wider  # noqa: F401
from loomspan.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
