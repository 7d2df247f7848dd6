"""Errors of the store."""


class StoreError(Exception):
    """Base of all errors here."""


class IntegrityError(StoreError):
    """Stored bytes contradict their digest, length or references."""


class FormatError(StoreError):
    """An encoding is malformed or of an unknown version."""


class RevisionConflict(StoreError):
    """An expectation about a key's revision does not hold."""

    def __init__(self, key: bytes, expected: object, actual: int | None) -> None:
        super().__init__(f"{key!r}: expected {expected}, found {actual}")
        self.key, self.expected, self.actual = key, expected, actual


class UnknownCodec(StoreError):
    pass


class UnknownGenerator(StoreError):
    pass


class MissingDependency(StoreError):
    """A dictionary or template that a body needs is not there."""


class LimitExceeded(StoreError):
    pass


class IdExhausted(StoreError):
    pass


class InvalidArgument(StoreError, ValueError):
    pass


class Unsupported(StoreError):
    pass
