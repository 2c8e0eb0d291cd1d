"""Registered queries, by subject."""
