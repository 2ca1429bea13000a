"""Words of a text in Python workers."""

from __future__ import annotations

import re

#: A longest run of letters or digits.
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Longest runs of letters or digits, lower-cased, in order; none for null."""
    return WORD.findall(text.lower()) if text else []
