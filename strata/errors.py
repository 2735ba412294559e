"""Errors with stable codes."""

from __future__ import annotations


class StrataError(Exception):
    """An error that callers tell apart by `code`; `hint` names what to write instead."""

    def __init__(self, code: str, message: str, hint: str | None = None):
        super().__init__(f"{code}: {message}" + (f" ({hint})" if hint else ""))
        self.code, self.hint = code, hint


class ConflictError(StrataError):
    """A commit lost to other writers more often than it may try again."""

    def __init__(self, attempts: int):
        super().__init__("CONFLICT", f"other writers won {attempts} times in a row")


class FormatError(StrataError):
    """The store was written by a newer format than this code reads."""

    def __init__(self, found: int, known: int):
        super().__init__("FORMAT", f"the store has format {found}, this version reads up to {known}")


class RowNotFoundError(StrataError):
    """A row addressed by its key does not exist."""

    def __init__(self, table: str, key: object):
        super().__init__("ROW_NOT_FOUND", f"{table} has no row with key {key!r}")


def unsupported(what: str, hint: str | None = None) -> StrataError:
    return StrataError("UNSUPPORTED_FEATURE", f"{what} is not part of the dialect", hint)
