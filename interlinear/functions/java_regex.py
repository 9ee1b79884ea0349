"""Java patterns read by Python's ``re``, for steps that leave Spark's columns."""

from __future__ import annotations

import re

_END = r"(?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z)"


def java(pattern: str, flags: int = 0) -> re.Pattern:
    """ASCII classes, and ``$`` also before a last line terminator. ``pattern``
    has no ``$`` in a character class."""
    return re.compile(pattern.replace("$", _END), re.ASCII | flags)
