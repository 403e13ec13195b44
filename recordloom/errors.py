"""Errors raised for requests that cannot be answered."""


class RecordError(ValueError):
    """Base of all errors a caller can correct."""


class UnknownColumn(RecordError):
    """A filter names a column the dataset does not have."""


class BadPattern(RecordError):
    """A filter value is not a usable pattern."""


class BadNumber(RecordError):
    """A limit or offset is not an integer."""


class NotReady(RecordError):
    """The dataset has no loaded data yet."""


class NotFound(RecordError):
    """No dataset has this id or alias."""


class Locked(RecordError):
    """The dataset is being loaded and cannot be dropped."""


class LoadRejected(RecordError):
    """The input breaks a loading rule; nothing is published."""
