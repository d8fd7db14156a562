"""Typed errors of the public interface."""


class StrataError(Exception):
    """Base of all errors raised by this package."""


class NotFound(StrataError):
    """A snapshot, symbol or file that was asked for does not exist."""


class StoreError(StrataError):
    """A snapshot can't be read or written."""
