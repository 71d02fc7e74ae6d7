"""Importing this module registers every plan."""
from quern.plans import enrichment, exchange, learning, library, searching, selection, streams, texts  # noqa: F401
