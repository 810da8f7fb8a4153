"""Streaming of the conditional-source engine."""
