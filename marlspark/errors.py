"""Errors that a statement can end in, by the names of the dialect."""


class DialectError(Exception):
    """Any error that aborts the statement and its transaction."""


class ParseError(DialectError):
    """The text is no statement; an open transaction goes on."""


class InternalError(DialectError):
    pass


class TableNotFoundError(DialectError):
    pass


class TableExistsError(DialectError):
    pass


class ColumnNotFoundError(DialectError):
    pass


class AmbiguousColumnError(DialectError):
    pass


class IndexNotFoundError(DialectError):
    pass


class IndexExistsError(DialectError):
    pass


class InvalidValueCountError(DialectError):
    pass


class StringOverflowError(DialectError):
    pass


class IncompatibleTypeError(DialectError):
    pass


class InvalidRecordSizeError(DialectError):
    pass


class InvalidColLengthError(DialectError):
    pass


class DatabaseExistsError(DialectError):
    pass


class DatabaseNotFoundError(DialectError):
    pass


class DuplicateKeyError(DialectError):
    pass


class IntegerRangeError(DialectError):
    pass


class DatetimeError(DialectError):
    pass


class TransactionAborted(DialectError):
    """A lock that another transaction holds: there is no waiting."""
