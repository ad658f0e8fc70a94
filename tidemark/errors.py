"""What a caller did wrong."""


class QueryError(ValueError):
    """A query that can't be run: unknown names, wrong types, or surface that the engine doesn't offer."""


class SchemaError(ValueError):
    """A table definition or a batch that breaks the rules of tables."""
