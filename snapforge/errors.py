"""Errors, and whether a caller may try again."""


class SnapshotError(Exception):
    retryable = False


class ConfigError(SnapshotError, ValueError):
    """An option, expression or schema that can't work."""


class ShardAssignmentError(SnapshotError):
    """A row that belongs to no shard."""


class ShardCoverageError(SnapshotError):
    """Attempts for shards that don't exist."""


class ManifestError(SnapshotError):
    """A manifest that can't be read."""


class PublishError(SnapshotError):
    """The manifest or the current pointer could not be written."""

    retryable = True


class StateError(SnapshotError):
    """A closed reader, or a store without snapshots."""
