"""Exceptions, one per kind of failure; all are raised on the driver."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager


class ChatError(Exception):
    """Base of all."""

    def is_io(self) -> bool:
        return isinstance(self, InputOutputError)

    def is_parse(self) -> bool:
        return isinstance(self, ParseError)

    def is_invalid_format(self) -> bool:
        return isinstance(self, InvalidFormatError)

    def is_invalid_date(self) -> bool:
        return isinstance(self, InvalidDateError)


class InputOutputError(ChatError):
    """A file can't be read or written."""


class ParseError(ChatError):
    """A document of *platform* is malformed."""

    def __init__(self, platform: str, message: str, path: str | None = None):
        self.platform, self.path = platform, path
        super().__init__(f"{platform}: {message}" + (f" ({path})" if path else ""))


class InvalidFormatError(ChatError):
    """The content is no export of *platform*."""

    def __init__(self, platform: str, message: str):
        self.platform = platform
        super().__init__(f"{platform}: {message}")


class InvalidDateError(ChatError):
    """A date isn't written YYYY-MM-DD or doesn't exist."""

    def __init__(self, text: str, expected: str = "YYYY-MM-DD"):
        self.input, self.expected = text, expected
        super().__init__(f"invalid date {text!r}, expected {expected}")


class CsvError(ChatError):
    """CSV can't be written or read."""


class JsonError(ChatError):
    """JSON can't be written or read."""


class StreamingError(ChatError):
    """A stream can't go on."""


class Utf8Error(ChatError):
    """Bytes are no UTF-8."""


class BufferOverflowError(ChatError):
    """A record is larger than the limit."""


class UnexpectedEndError(ChatError):
    """A document ends inside a record."""


# What Spark's message of a failed task tells, and the exception it stands for.
_TOLD = [
    (r"(\w+): (no valid document with messages in [^\n\"]*|a malformed (?:record|line)[^\n\"]*)", ParseError),
    (r"(\w+): (unknown format of the export [^\n\"]*)", InvalidFormatError),
]
_SIGNS = [
    ("UnexpectedEndError", UnexpectedEndError), ("BufferOverflowError", BufferOverflowError), ("UnicodeDecodeError", Utf8Error), ("INVALID_UTF8_STRING", Utf8Error), ("_csv.Error", CsvError),
    ("JSONDecodeError", JsonError), ("MALFORMED_RECORD_IN_PARSING", JsonError), ("PATH_NOT_FOUND", InputOutputError), ("FileNotFoundException", InputOutputError), ("StreamingQueryException", StreamingError),
]


def translated(e: BaseException) -> ChatError | None:
    """The exception of this library that a failed action of Spark stands for, or null."""
    if isinstance(e, ChatError):
        return e
    text = f"{type(e).__name__}: {e}"
    for pattern, kind in _TOLD:
        if m := re.search(pattern, text):
            return kind(m[1], m[2])
    for sign, kind in _SIGNS:
        if sign in text:
            return kind(str(e).split("\n")[0])
    return None


@contextmanager
def typed_errors() -> Iterator[None]:
    """Actions inside raise this library's exceptions: ``with typed_errors(): parse_chat(...).collect()``."""
    try:
        yield
    except Exception as e:
        if (other := translated(e)) is None or other is e:
            raise
        raise other from e
