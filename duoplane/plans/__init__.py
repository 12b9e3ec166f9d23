"""Registered example plans over the test tables."""
