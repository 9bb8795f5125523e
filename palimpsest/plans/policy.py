"""Access rules as SQL text, for catalogs that have roles."""

from __future__ import annotations

from ..identifiers import validate_identifier


def revoke_writes(table: str, role: str, context_table: str | None = None) -> list[str]:
    """The application may add to the log and read it, and change nothing."""
    names = [validate_identifier(n, "table") for n in (table, *([context_table] if context_table else []))]
    validate_identifier(role, "role")
    out = [f"REVOKE UPDATE, DELETE, TRUNCATE ON TABLE {n} FROM ROLE {role}" for n in names]
    return [f"REVOKE INSERT ON TABLE {names[0]} FROM ROLE {role}", *out]


def grant_admin(table: str, role: str, context_table: str | None = None) -> list[str]:
    names = [validate_identifier(n, "table") for n in (table, *([context_table] if context_table else []))]
    return [f"GRANT SELECT, INSERT, UPDATE, DELETE ON TABLE {n} TO ROLE {validate_identifier(role, 'role')}" for n in names]
