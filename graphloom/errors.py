"""Errors of the query layer; all are raised before a Spark job starts unless they depend on data."""


class QueryError(ValueError):
    """A statement that cannot be run."""


class ParseError(QueryError):
    """Text that is no statement."""


class Unsupported(QueryError):
    """A statement outside of the supported subset."""


class MissingParameter(QueryError):
    """A parameter that the statement uses but the caller has not given."""


class LimitExceeded(QueryError):
    """A configured limit would be passed."""


class Conflict(QueryError):
    """A write that contradicts the graph or an earlier write."""
