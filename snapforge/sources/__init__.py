"""Reading and writing snapshots: manifests, pointers, run records."""
