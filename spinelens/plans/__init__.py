"""Composite plans a user calls."""
