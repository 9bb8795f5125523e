"""What is captured of a table, resolved against its columns when a plan is made."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

from .identifiers import validate_identifier
from .schema import OPERATIONS

#: Rises whenever capture gives other events for the same declaration.
CAPTURE_VERSION = 2


@dataclass(frozen=True)
class Capture:
    """A declaration: ``columns`` are the only ones that updates and inserts are compared by (all
    if not given), ``without`` are never compared; the row images stay whole. ``keep`` are new
    values that go along with each event, ``where`` is a trusted Spark SQL condition over the
    structs OLD and NEW and the map CTX. With ``unchanged``, an update that changes none of the
    compared columns is an event as well, with an empty diff."""

    table: str
    log: str = "auditlog"
    columns: tuple[str, ...] | None = None
    without: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()
    where: str | None = None
    label: str | None = None
    unchanged: bool = False

    def __post_init__(self) -> None:
        for kind, names in {"table": [self.table, self.log], "column": [*(self.columns or ()), *self.without, *self.keep], "label": [self.label] if self.label is not None else []}.items():
            for name in names:
                validate_identifier(name, kind)
        if self.columns is not None and (self.without or not self.columns):
            raise ValueError("columns need a name, and rule out `without`")

    @property
    def name(self) -> str:
        return self.label or f"{self.table}_to_{self.log}"

    def compared(self, names: Iterable[str], operation: str) -> list[str]:
        """Columns of an event's diff. A DELETE has no new row that ``columns`` could choose from, so
        its diff shows every column that is not left out."""
        chosen = set(names) if self.columns is None or operation == "DELETE" else set(self.columns)
        return [n for n in names if n in chosen and n not in self.without]

    def plan(self, names: Iterable[str] | None = None) -> CapturePlan:
        """The plan over a table's columns, or over any columns if they are not known yet."""
        if names is None:
            every = "*" if not self.without else f"* except {sorted(self.without)}"
            lists = {o: every if self.columns is None or o == "DELETE" else str(sorted(self.columns)) for o in OPERATIONS}
        else:
            names = list(names)
            lists = {o: str(self.compared(names, o)) for o in OPERATIONS}
        lines = [f"capture {self.table} into {self.log}", *(f"{o.lower()} compares {x}" for o, x in lists.items()), f"keeps {sorted(self.keep)}", f"where {self.where or 'always'}", *(["unchanged updates too"] if self.unchanged else [])]
        text = "\n".join(lines)
        return CapturePlan(self, text, hashlib.sha256(f"{CAPTURE_VERSION}\n{self.name}\n{text}".encode()).hexdigest())


@dataclass(frozen=True)
class CapturePlan:
    capture: Capture
    text: str
    checksum: str
