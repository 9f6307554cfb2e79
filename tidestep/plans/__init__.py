"""plans of the step engine."""
