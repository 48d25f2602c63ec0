"""Declarations (contracts, specs) and the query catalogue."""
