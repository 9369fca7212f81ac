"""Streams into keyed tables."""
