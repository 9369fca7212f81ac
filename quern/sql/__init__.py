"""Text to syntax tree."""
