"""Query plans over the tables: what __spark_entry__.py registers."""
