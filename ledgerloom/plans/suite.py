"""All registered queries."""

from . import q_files, q_master, q_matching, q_profile, q_quality, q_tables, q_text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
