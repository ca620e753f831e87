"""Operators over DataFrames: sharding, snapshots, lookups, vectors, life cycle, sizing."""
