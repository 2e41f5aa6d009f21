"""sources of the analysis engine."""
