"""plans of the privacy engine."""
