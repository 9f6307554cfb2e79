"""sources of the step engine."""
