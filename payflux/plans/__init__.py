"""Whole jobs made of the operators, and the named queries."""
