"""Incremental runs over event tables."""
