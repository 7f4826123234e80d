"""Errors a caller can act on."""


class DataValidationError(ValueError):
    """The supplied data cannot be analysed as given; the message says what to fix."""
