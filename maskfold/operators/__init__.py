"""operators of the privacy engine."""
