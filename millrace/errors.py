"""Exceptions of the library."""


class MillraceError(Exception):
    """Base of all errors raised here."""


class EnvironmentError(MillraceError):  # noqa: A001
    """A program or setting that an operation needs is missing."""


class PathError(MillraceError):
    """Something is wrong with a path."""


class PathDoesNotExist(PathError):
    """A path that must exist does not."""


class PathExists(PathError):
    """A path that must not exist does."""


class InvalidFileType(PathError):
    """A file is not of the type that an operation reads."""


class SchemaError(MillraceError):
    """A dataset lacks a column, or a column has another type or nulls."""


class UnknownUser(MillraceError):
    """A user that must exist does not."""


class UnhandledToken(MillraceError, ValueError):
    """A disassembler's token that the grammar does not know."""


class RemoteException(MillraceError):
    """A guarded child process failed; the message holds its traceback."""


__all__ = [
    "EnvironmentError",
    "InvalidFileType",
    "MillraceError",
    "PathDoesNotExist",
    "PathError",
    "PathExists",
    "RemoteException",
    "SchemaError",
    "UnhandledToken",
    "UnknownUser",
]
