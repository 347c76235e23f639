"""Corvane sources."""
