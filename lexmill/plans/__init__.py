"""Compositions of operators into whole queries."""
