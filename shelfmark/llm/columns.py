"""Column names that don't clash with those of the caller's table."""

from __future__ import annotations


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it until no column in ``taken`` has it."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name
