"""Queries of the llm subpackage."""

from kerbflow.llm import queries  # noqa: F401
from kerbflow.llm.catalog import ORACLES, QUERIES  # noqa: F401
