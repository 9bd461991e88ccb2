"""Errors with a machine-readable rule and field; their classes are stable, their messages are not."""

from __future__ import annotations


class RecordError(Exception):
    """Base of all errors of this library."""

    def __init__(self, message: str, rule: str | None = None, field: str | None = None):
        super().__init__(message)
        self.rule, self.field = rule, field


class ContractError(RecordError):
    """A contract doesn't compile or isn't the store's."""


class LimitError(RecordError):
    """A bound of a read is out of its range."""


class ReferenceError_(RecordError):
    """A named record, boundary or endpoint doesn't exist."""


class IdentityError(RecordError):
    """An identifier stands for more than one record."""


class StalePlanError(RecordError):
    """The store moved on after the plan was made."""


class InvalidPlanError(RecordError):
    """A plan with issues, or one that was changed, can't be committed."""


class ReplayConflictError(RecordError):
    """An idempotency key was used for different content."""


class SnapshotError(RecordError):
    """A snapshot doesn't belong to the store or was changed."""


class MeasureError(RecordError):
    """A measure's definition or call isn't allowed."""


class HistoryError(RecordError):
    """A boundary of history doesn't exist or can't be read."""


class SnapshotBoundaryError(SnapshotError, HistoryError):
    """A boundary is later than the snapshot that is read."""
