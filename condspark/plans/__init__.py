"""Plans of the conditional-source engine."""
