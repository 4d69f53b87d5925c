"""Errors that callers tell apart."""


class EngineError(Exception):
    """Any failure with a message for the user."""


class InvalidPlan(EngineError):
    """A plan that breaks the grammar or names unknown columns."""


class UnsupportedSql(EngineError):
    """SQL text that is no single query over the given dataset."""


class NotFound(EngineError):
    """No such dataset, snapshot or file, or none that this workspace may see."""


class BadFile(EngineError):
    """A source whose content can't be read as what it claims to be."""
