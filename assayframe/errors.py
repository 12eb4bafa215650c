"""Errors raised on the driver while a plan is built."""


class EvaluationError(Exception):
    """Base of this library's errors."""


class CaseValidationError(EvaluationError):
    """A case file or an argument is not valid."""


class EmptyFolderError(EvaluationError):
    """A set of cases is missing or has none."""


class SkillError(EvaluationError):
    """A skill document cannot be found or created."""


class JudgeError(EvaluationError):
    """No attempt gave a valid verdict."""
