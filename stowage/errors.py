"""Errors raised by the library."""


class StowageError(Exception):
    """Base class."""


class UnsupportedFormat(StowageError):
    """The file format, codec or column type cannot be stored as asked."""


class SnapshotIncomplete(StowageError):
    """The snapshot has no complete dataset manifest, so it was never committed."""


class VersionMismatch(StowageError):
    """A manifest row was written under another metadata version."""


class ObjectExists(StowageError):
    """The target object exists and overwriting was not asked for."""


class PartitionFilterRequired(StowageError):
    """The table may only be read with a filter on its partition field."""


class GraphError(StowageError):
    """A dependency graph has duplicate nodes or a cycle."""
