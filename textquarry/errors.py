"""Typed errors raised before a job is submitted."""


class TextQuarryError(Exception):
    """Base class of every error raised by this package."""


class CollectionNotFoundError(TextQuarryError, ValueError):
    """The named collection is not registered."""


class CollectionExistsError(TextQuarryError, ValueError):
    """The target collection name is already taken."""


class SourceNotFoundError(TextQuarryError, FileNotFoundError):
    """The folder to ingest does not exist."""


class TableNotFoundError(TextQuarryError, ValueError):
    """The table to ingest does not exist."""
