"""Composed plans: hybrid search and presets."""
