"""Registered queries over the directory engine, each with SQL for the same rows where SQL can express them."""

from . import case_queries, directory_queries, evaluation_queries, record_queries, transcript_queries, varied_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
