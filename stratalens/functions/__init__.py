"""functions of the analysis engine."""
