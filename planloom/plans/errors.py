"""Errors that carry a reason a program can count."""


class Rejected(ValueError):
    """Input outside the closed plan.  ``reason`` is a stable identifier."""

    def __init__(self, reason: str, detail: str = ""):
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.reason = reason


class PlanError(Rejected):
    """A plan or its text form is malformed."""


class SqlRejected(Rejected):
    """A statement is not in the supported SQL subset."""


class AnalysisError(Rejected):
    """A plan does not fit the catalog, or fits it in more than one way."""
