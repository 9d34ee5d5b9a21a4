"""Registered queries and the entry API."""

from . import catalogue, catalogue_audio, catalogue_jobs, catalogue_long, catalogue_streams, catalogue_text  # noqa: F401 (registering)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
