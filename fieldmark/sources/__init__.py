"""Readers for the warehouse tables."""

from fieldmark.sources.tables import read_table

__all__ = ["read_table"]
