"""Sources of the conditional-source engine."""
