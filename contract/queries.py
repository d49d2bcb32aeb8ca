"""All registered queries."""

from . import code_queries, report_queries, vector_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
