"""Errors of the library."""


class ConfigurationError(ValueError):
    """A name, option or builder call is not allowed."""


class TombstoneNotSupported(RuntimeError):
    """A source record has no value: deletes have to be flagged in the value."""


class SearchWriteError(RuntimeError):
    """A bulk write failed for good."""
