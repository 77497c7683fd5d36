"""Input problems a caller can fix."""

from __future__ import annotations


class InputError(ValueError):
    """Carries a stable ``code`` and the facts needed to correct the input."""

    def __init__(self, code: str, message: str, **context):
        super().__init__(message)
        self.code = code
        self.message = message
        self.context = context
