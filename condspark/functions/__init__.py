"""Functions of the conditional-source engine."""
