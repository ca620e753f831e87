"""Columns: stable hashes, key and value encodings, routing expressions, distances."""
