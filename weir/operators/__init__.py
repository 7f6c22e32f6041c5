"""Operators of the engine: versioned tables, journal, swap, merge, fan-out, checks."""
