"""Snapshots from streams."""
