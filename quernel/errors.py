"""Errors that the engine raises."""


class EngineError(Exception):
    """Any error of the engine."""


class ParseError(EngineError):
    """The text isn't a statement of the dialect."""


class SchemaError(EngineError):
    """A table, column, index or constraint is missing, repeated or of the wrong kind."""


class ExecutionError(EngineError):
    """A statement can't be carried out on these values."""


class UniqueViolation(ExecutionError):
    """A primary key or unique value would repeat."""


class ForeignKeyViolation(ExecutionError):
    """A reference would dangle."""


class CheckViolation(ExecutionError):
    """A NOT NULL, CHECK or range rule is broken."""


class TransactionError(EngineError):
    """BEGIN, COMMIT, ROLLBACK or a savepoint out of place."""


class LockError(EngineError):
    """Another writer published first, or holds the lock."""


class Cancelled(EngineError):
    """The statement was cancelled."""


class StatementTimeout(Cancelled):
    """The statement ran out of time."""
