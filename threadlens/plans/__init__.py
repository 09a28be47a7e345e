"""Composite, user-facing jobs."""
