"""Typed errors of queries, the model, and changes."""


class QueryError(ValueError):
    """A query that cannot be answered as it is written."""

    code = "AO_BAD_OPERATION"


class BadSyntax(QueryError):
    """The query's form is not one of those documented."""

    code = "AO_QUERY_INVALID"


class UnknownEntity(QueryError):
    code = "AO_INVALID_ELEMENT"


class UnknownAttribute(QueryError):
    code = "AO_MISSING_ATTRIBUTE"


class UnknownRelation(QueryError):
    code = "AO_INVALID_RELATION"


class BadValue(QueryError):
    """A literal that its attribute's type cannot hold."""

    code = "AO_BAD_PARAMETER"


class UnknownUnit(QueryError):
    code = "AO_UNKNOWN_UNIT"


class IncompatibleUnits(QueryError):
    code = "AO_INCOMPATIBLE_UNITS"


class ConstraintError(QueryError):
    """A change that breaks an obligatory or a unique attribute."""

    code = "AO_DUPLICATE_VALUE"


class TransactionActive(QueryError):
    code = "AO_TRANSACTION_ALREADY_ACTIVE"


class TransactionNotActive(QueryError):
    code = "AO_TRANSACTION_NOT_ACTIVE"


class NotThere(QueryError):
    """A connection, path or instance that does not exist."""

    code = "AO_NOT_FOUND"
