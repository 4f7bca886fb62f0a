"""Failures by the stage that finds them."""


class SemanticError(Exception):
    """Any failure of the semantic layer; `status` is the envelope's."""

    status = "compile_error"


class SchemaError(SemanticError):
    """A model or a request that does not read."""

    status = "parse_error"


class QueryError(SemanticError):
    """A request that names something the model lacks, or misuses it."""


class JoinError(SemanticError):
    """Views that no chain of entities connects."""


class PlanError(SemanticError):
    """A request that reads well but has no plan."""


class SourceError(SemanticError):
    """A connection, file or credential that cannot be used."""

    status = "execution_error"
