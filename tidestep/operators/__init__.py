"""operators of the step engine."""
