"""Errors with stable codes."""

from __future__ import annotations

# Codes and what they stand for.
CODES = {
    "E1001": "invalid configuration",
    "E1101": "input can't be opened",
    "E1102": "unsupported input format",
    "E1103": "input can't be parsed",
    "E1104": "input is empty",
    "E1201": "reference can't be opened",
    "E1202": "invalid reference",
    "E1301": "resource is missing",
    "E1302": "invalid resource",
    "E1401": "dependency is missing",
    "E1501": "cancelled",
    "E1601": "work budget exhausted",
    "E9001": "internal error",
}


class AnalysisError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code
