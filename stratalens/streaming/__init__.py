"""streaming of the analysis engine."""
