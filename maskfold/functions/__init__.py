"""functions of the privacy engine."""
