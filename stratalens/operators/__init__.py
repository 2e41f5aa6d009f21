"""operators of the analysis engine."""
