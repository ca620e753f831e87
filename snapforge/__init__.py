"""A PySpark-native engine for building, serving and operating immutable sharded snapshots."""

__version__ = "0.1.0"
