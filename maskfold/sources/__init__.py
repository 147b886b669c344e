"""sources of the privacy engine."""
