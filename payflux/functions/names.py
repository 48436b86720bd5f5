"""Names that don't clash."""

from __future__ import annotations

from collections.abc import Iterable


def unused(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores in front until no column has it."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
