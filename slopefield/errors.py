"""Errors meant for the person who supplied the data."""


class DataError(ValueError):
    """The table cannot be trained on; the message says why in plain words."""
