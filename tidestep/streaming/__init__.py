"""streaming of the step engine."""
