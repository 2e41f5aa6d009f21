"""plans of the analysis engine."""
