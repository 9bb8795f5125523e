"""Names that may stand in plans and paths."""

from __future__ import annotations

import re

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def validate_identifier(name: str, label: str = "identifier") -> str:
    """``name`` if it is a plain identifier; a trailing line break is none."""
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise ValueError(f"invalid {label}: {name!r}")
    return name
