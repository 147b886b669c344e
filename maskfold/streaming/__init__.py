"""streaming of the privacy engine."""
