"""Corvane streaming."""
