"""Errors of the library; each names the kind of answer a service would give."""


class GridError(Exception):
    """Base of all errors raised here."""


class BadRequest(GridError):
    """The request can't be carried out as stated: syntax, types, bounds."""


class NotFound(GridError):
    """No such database, column or index."""


class Conflict(GridError):
    """It exists already."""


class Forbidden(GridError):
    """A write through a read-only handle."""
