"""Operators for large text collections that feed language-model training."""
