"""Errors of declarations: a code, a message, and where the declaration stands."""

from __future__ import annotations

import inspect


class DeclarationError(ValueError):
    def __init__(self, code: str, message: str):
        frame = next((f for f in inspect.stack()[1:] if "/terrane/" not in f.filename), None)
        self.code, self.site = code, f"{frame.filename}:{frame.lineno}" if frame else "unknown"
        super().__init__(f"{code}: {message} (declared at {self.site})")


def require(ok: object, code: str, message: str) -> None:
    if not ok:
        raise DeclarationError(code, message)
