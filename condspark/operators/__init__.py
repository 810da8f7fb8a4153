"""Operators of the conditional-source engine."""
