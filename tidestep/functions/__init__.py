"""functions of the step engine."""
