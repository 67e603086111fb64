"""Errors of stores and their metadata."""


class StoreError(Exception):
    """Base of all errors of a store."""


class StoreIOError(StoreError):
    """A read or write failed."""


class NoSuchKeyError(StoreIOError):
    """A key that has to exist doesn't."""


class AttributeTypeError(StoreError):
    """An attribute can't be read as the wanted type."""


class AttributeParseError(StoreError):
    """A group's attributes aren't JSON."""


class ChecksumError(StoreError):
    """Stored and computed checksums differ."""


class ConcurrentWriteError(StoreError):
    """A key was written by another writer at the same time."""
