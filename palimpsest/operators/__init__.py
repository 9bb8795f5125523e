"""Operators over row changes and the audit log."""
