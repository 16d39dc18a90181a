"""Composed flows and the registered queries."""
