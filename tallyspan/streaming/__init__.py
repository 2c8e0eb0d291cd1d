"""Incremental paths: growing files, passes over new records, per-day partials."""
