"""Registered queries over the given tables, each with its SQL twin."""

from plenum.catalog import contracts, lengths, preference, prompting, reports, sampling, standard, storage, texts, voting  # noqa: F401
from plenum.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
