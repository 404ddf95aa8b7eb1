"""Errors that a caller's query or data cause."""


class ParseError(ValueError):
    """The query text isn't in the grammar. ``at`` is the character."""

    def __init__(self, what: str, at: int = -1):
        super().__init__(f"{what} at character {at}" if at >= 0 else what)
        self.at = at


class QueryError(ValueError):
    """The query is well formed but asks for what it doesn't bind."""
